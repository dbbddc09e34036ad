"""Placement of rows on shards by a hierarchical tree of weighted hash draws.

The tree has regions, racks and shards.  A row descends it: at every level each child
draws ``-ln(u) / weight`` from a hash of the row's key and the child's name, and the
smallest draw wins, so children receive rows in proportion to their weights.  A draw
depends on nothing but key, name and weight of that child.  When a weight grows, rows move
only into the branch that holds it; branches whose weights stay never exchange rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sunledger.operators.skew import global_position

#: 52 bits of an md5 make a draw
_DIGITS, _RANGE = 13, float(16 ** 13)


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n_shards: int, racks: int = 2, shards_per_rack: int = 4) -> list[Shard]:
    """Shards 0 to n-1, filled region by region and rack by rack."""
    per_region = racks * shards_per_rack
    return [Shard(f"g{i // per_region}", f"k{i % per_region // shards_per_rack}", i)
            for i in range(n_shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own.

    No weight inside the old regions changes, so the new shard takes rows only into itself.
    """
    number = max((s.shard for s in tree), default=-1) + 1
    regions = {s.region for s in tree}
    name = f"g{len(regions)}"
    while name in regions:
        name += "'"
    return [*tree, Shard(name, "k0", number, weight)]


def draw(key: Column, name: str, weight: float) -> Column:
    """The draw of one child: exponential with rate ``weight``."""
    head = F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, _DIGITS)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(_RANGE)
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """Value of the child with the smallest draw; ties go to the child listed first."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(draw(key, name, weight).alias("d"), F.lit(i).alias("i"), value.alias("v"))
             for i, (name, weight, value) in enumerate(children)]
    return F.least(*draws)["v"]


def place(key: Column, tree: list[Shard]) -> Column:
    """Shard of a key (a string column); a NULL key counts as the empty string."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a positive weight")
    key = F.coalesce(key, F.lit(""))

    def level(shards: list[Shard], depth: int, path: str) -> Column:
        names = [lambda s: s.region, lambda s: s.rack, lambda s: str(s.shard)]
        groups: dict[str, list[Shard]] = {}
        for s in shards:
            groups.setdefault(names[depth](s), []).append(s)
        children = []
        for name, own in groups.items():
            full = f"{path}/{name}"
            value = F.lit(own[0].shard) if depth == 2 else level(own, depth + 1, full)
            children.append((full, sum(s.weight for s in own), value))
        if depth == 2:
            return _winner(key, children)
        # choose the branch first, then descend into that branch alone
        if len(children) == 1:
            return children[0][2]
        pick = _winner(key, [(n, w, F.lit(i)) for i, (n, w, _) in enumerate(children)])
        chosen = F.when(pick == 0, children[0][2])
        for i, (_, _, value) in enumerate(children[1:], 1):
            chosen = chosen.when(pick == i, value)
        return chosen

    return level(live, 0, "")


def shard_rows(df: DataFrame, key: str, text: str, tree: list[Shard]) -> DataFrame:
    """One row per input row: key, size, crc of the text, shard, slot, shard after growth.

    The slot is the row's rank in its shard by (key, crc, size), from 0, found by a
    range-partitioned sort with a tie-breaker, so neither a hot key nor a heavy shard meets
    in one task.  Repeated rows get slots of their own, a NULL key is placed as the empty
    string and sorts first, a NULL text has no bytes (size 8, crc 0).  Other columns of the
    input are left out.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    name = F.col(key).cast("string")
    narrow = df.select(
        F.col(key).alias("key"), (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"), place(name, tree).alias("shard"),
        place(name, grown(tree)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_tie"))
    placed = global_position(narrow, ["shard", "key", "text_crc32", "size", "_tie"], "_pos")
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")
            .withColumn("slot", F.col("_pos") - F.col("_first")).drop("_pos", "_first", "_tie"))
