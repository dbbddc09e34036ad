"""A Merkle manifest of a data set by slot pivots.

Every row is a leaf; the leaves of a group, in the order of their key, stand below the group's
subroot, and the subroots, in the order of their group, below one root.  Each ``fanout``
consecutive nodes have one parent.

A hop climbs several levels at once.  Conditional aggregates spread the nodes below one
ancestor into columns, one a slot; concatenating a run's columns and hashing gives the parent,
and leaving out a node's own column gives its siblings.  On the way down the same columns are
turned back into rows, which hand the siblings found above to the nodes below.  A hop of 16
slots leaves a sixteenth of the rows, so all hops together shuffle little more than the leaves
do, and no group of rows is larger than the slots of one ancestor, however large a group is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sunledger.llm.ordering import ranked, small
from sunledger.operators.skew import join_groups
from sunledger.session import settle

#: most slots that one hop spreads into columns
MOST_SLOTS = 16
_PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a digest reads it: ``-`` for NULL, else byte count, colon and value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


@dataclass
class Tree:
    """Pivots of a forest, lowest hop first, and one root per group."""

    group: str
    fanout: int
    levels: int
    pivots: list[DataFrame]
    roots: DataFrame

    @property
    def slots(self) -> int:
        return self.fanout ** self.levels


def _nodes(fanout: int, level: int) -> str:
    """Nodes that the ``n`` nodes of a group have ``level`` levels above them."""
    span = fanout ** level
    return f"((n + {span - 1}) div {span})"


def _hashed(pivot: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The pivot with ``d<level>_<i>``: the digests of all nodes at every level of the hop.

    Where a group has one node left, that node is its root and is handed up unchanged.
    (The columns are many; SQL text states them in one call.)
    """
    slots = fanout ** levels
    out = pivot.selectExpr("*", *[f"s{i}.digest as d0_{i}" for i in range(slots)])
    for level in range(1, levels + 1):
        parents = []
        for i in range(fanout ** (levels - level)):
            kids = [f"d{level - 1}_{i * fanout + k}" for k in range(fanout)]
            joined = ", ".join(f"coalesce({k}, '')" for k in kids)
            parents.append(
                f"case when {kids[0]} is null then null when {_nodes(fanout, level - 1)} > 1 "
                f"then sha2(concat({joined}), 256) else {kids[0]} end as d{level}_{i}")
        out = out.selectExpr("*", *parents)
    return out


def grow(leaves: DataFrame, group: str, largest: int, fanout: int = 2) -> Tree:
    """The tree over ``(group, idx, n, digest, ...)``.

    ``idx`` is the place of a leaf in its group, ``n`` the leaves of the group and ``largest``
    the greatest ``n``; further columns come back with the leaf in ``proofs``.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of at least 2")
    levels = 1
    while fanout ** (levels + 1) <= MOST_SLOTS:
        levels += 1
    slots = fanout ** levels
    most, pivots, nodes = largest, [], leaves
    while True:
        kept = [c for c in nodes.columns if c not in (group, "idx", "n")]
        spread = [F.expr(f"first(case when idx % {slots} = {i} then struct({', '.join(kept)}) "
                         f"end, true) as s{i}") for i in range(slots)]
        pivots.append(settle(
            nodes.groupBy(group, F.expr(f"idx div {slots}").alias("idx"))
            .agg(F.first("n").alias("n"), *spread)))
        nodes = _hashed(pivots[-1], fanout, levels).selectExpr(
            group, "idx", f"{_nodes(fanout, levels)} as n", f"d{levels}_0 as digest")
        if most <= slots:
            break
        most = -(-most // slots)
    return Tree(group, fanout, levels, pivots, nodes.select(group, "digest"))


def _siblings(slot: int, fanout: int, levels: int) -> str:
    """What a slot's node and its ancestors in the hop are hashed with, lowest level first."""
    steps = []
    for level in range(1, levels + 1):
        run, own = divmod(slot // fanout ** (level - 1), fanout)
        kids = [f"coalesce(d{level - 1}_{run * fanout + k}, '')" for k in range(fanout)]
        left, right = (", ".join(["''", *side]) for side in (kids[:own], kids[own + 1:]))
        steps.append(f"case when {_nodes(fanout, level - 1)} > 1 "
                     f"then struct(concat({left}) as l, concat({right}) as r) end")
    return f"array_compact(array({', '.join(steps)}))"


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """Every leaf with its columns and ``path``: the siblings (``l`` left and ``r`` right of
    the node) of each level up to its root.

    ``above`` has one row a group, with a ``path`` to be appended and columns to hand down.
    """
    handed = [c for c in above.columns if c not in (tree.group, "path")]
    top = above.withColumn("idx", F.lit(0).cast("long"))
    for pivot in reversed(tree.pivots):
        hashed = _hashed(pivot, tree.fanout, tree.levels)
        met = join_groups(hashed, top, [tree.group, "idx"])
        carried = [f"s{{i}}.{c} as {c}" for c in pivot.schema["s0"].dataType.names]
        slots = [f"struct(idx * {tree.slots} + {i} as idx, concat("
                 f"{_siblings(i, tree.fanout, tree.levels)}, path) as path, "
                 f"{', '.join(carried).format(i=i)})" for i in range(tree.slots)]
        held = f"explode(filter(array({', '.join(slots)}), s -> s.digest is not null)) as _s"
        top = met.selectExpr(tree.group, *handed, held).select(tree.group, *handed, "_s.*")
        if pivot is not tree.pivots[0]:
            top = top.drop("digest")
    return top


def manifest(docs: DataFrame, key: str, group: str, leaf: Column, fanout: int = 2,
             changed: Column | None = None) -> DataFrame:
    """``(key, group, leaf, changed, subroot, root, path)`` of every row.

    ``leaf`` is the digest of a row.  Leaves stand by key, rows of one key by their digests;
    NULL keys come first and a NULL group is a group.  Repeated rows are leaves of their own.
    ``changed`` is another digest of the same row, to be held against the manifest; it is NULL
    where not given.  Other columns of ``docs`` are not looked at; no rows give none.
    """
    leaves = settle(docs.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed")))
    sizes = small(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    n_groups, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    no_path = F.array().cast(_PATH).alias("path")
    if n_groups:
        placed = join_groups(ranked(leaves, ["grp"], ["key", "digest"], "idx"), sizes, ["grp"])
        groups = grow(placed, "grp", largest, fanout)
        roots = settle(groups.roots.select(F.lit(0).alias("one"), "grp", "digest"))
        whole = grow(ranked(roots, ["one"], ["grp"], "idx")
                     .withColumn("n", F.lit(n_groups).cast("long")), "one", n_groups, fanout)
        start = whole.roots.select("one", F.col("digest").alias("root"), no_path)
        tops = proofs(whole, start).select("grp", "root", F.col("digest").alias("subroot"),
                                           "path")
        found = proofs(groups, tops)
    else:
        found = leaves.withColumns({"root": F.col("digest"), "subroot": F.col("digest"),
                                    "path": no_path})
    return found.select("key", F.col("grp").alias("group"), F.col("digest").alias("leaf"),
                        "changed", "subroot", "root", "path")


def check_proofs(rows: DataFrame) -> DataFrame:
    """``proof_sha256`` of the siblings up to the root, ``folded_root`` folded from the changed
    leaf (the leaf itself where there is none), and ``verified``: that it is the root."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "leaf"),
                         lambda node, s: digest(s["l"], node, s["r"]))
    return (rows.withColumns({"proof_sha256": digest(siblings), "folded_root": folded})
            .withColumn("verified", F.col("folded_root") == F.col("root")))
