"""The trie of conversation prefixes, its nodes in minimal perfect hash tables.

Every conversation is a path from the root; two conversations share the nodes of the turns
that they have in common at their start.  A node is named by the digest of its prefix: the sum
of a digest of each turn with its depth, in two lanes of 64 bits, so that the digest of a long
conversation can be continued in another task.

Conversations are dealt to shards whole, or in segments of bounded length.  A shard enumerates
its distinct prefix digests, gives each a slot by a minimal perfect hash whose table holds the
digests themselves (a look-up compares them), and scatters its counts into flat arrays.  Spark
adds up the shards' counts per digest.  Each node then belongs to the shard of its smallest
conversation; every shard accumulates what its nodes weigh through its array of parent slots,
deepest nodes first, and Spark adds up the shards' sums.  A node with very many conversations
is one row per shard, never a group of its conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sunledger.llm.common import mix
from sunledger.llm.ordering import ranked
from sunledger.session import settle

#: most turns of one conversation in a shard, and rows that a shard has on average
SEGMENT, SHARD_ROWS = 4096, 60_000
#: characters of a piece of a list of ids
PIECE = 1 << 16
_LOW = (1 << 32) - 1
_NOBODY = np.iinfo(np.int64).max
_SEEDS = 64


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys, with the keys at their slots.

    Each round hashes the keys left into a bitmap; keys alone at their place take the rank of
    their bit as slot, the others go on.  ``find`` compares the key stored at the slot, so a
    foreign key gets -1 and no collision passes.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self._rounds: list[tuple[np.ndarray, np.ndarray]] = []
        slots = np.empty(len(a), np.int64)
        left, taken = np.arange(len(a)), 0
        while len(left):
            if len(self._rounds) == _SEEDS:
                raise ValueError("keys of a slot table must be distinct")
            size = len(left) + len(left) // 2 + 1
            at = self._place(a[left], b[left], len(self._rounds), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = taken + np.cumsum(alone) - 1
            self._rounds.append((alone, ranks))
            settled = alone[at]
            slots[left[settled]] = ranks[at[settled]]
            taken += int(alone.sum())
            left = left[~settled]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, seed: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = mix(a + mix(b + np.uint64(seed * 0x9E3779B9 + 1)))
        return (spread % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.a)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for a key that the table does not hold."""
        slots = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for seed, (alone, ranks) in enumerate(self._rounds):
            at = self._place(a[left], b[left], seed, len(alone))
            hit = alone[at]
            slots[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        known = slots >= 0
        same = (self.a[slots[known]] == a[known]) & (self.b[slots[known]] == b[known])
        slots[np.flatnonzero(known)[~same]] = -1
        return slots


def distinct_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


# --- rebuilt conversations ------------------------------------------------------------------

def rebuilt(conversations: DataFrame, family: Column, shared: Column, most_shared: int,
            conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of the one their family is named after.

    ``family`` and ``shared`` are computed from the conversation's id, called ``conv``: the
    conversation starts with the first ``shared`` (at most ``most_shared``) turns of the
    conversation ``family``, and goes on with its own turns after its first ``shared``.  Turns
    stand by ``turn`` (NULL first), equal ones by role and then by the digest of their text; a
    NULL role or text is empty; rows without an id take no part.  The first result has
    ``(conv, family, shared, kept, total)`` per conversation, with ``kept`` turns taken and
    ``total`` turns altogether, the second ``(conv, family, depth, key, bytes, last)`` per turn.
    """
    empty = F.lit("")
    who, said = F.coalesce(F.col(role), empty), F.coalesce(F.col(text), empty)
    named = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    turns = settle(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"),
        F.unhex(F.sha2(named.cast("binary"), 256)).alias("key"),
        F.octet_length(said).cast("long").alias("bytes")))
    placed = settle(ranked(turns, ["conv"], ["turn", "role", "key"], "pos")
                    .select("conv", (F.col("pos") + 1).alias("pos"), "key", "bytes"))

    lengths = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    of_family = lengths.select(F.col("conv").alias("family"), F.col("length").alias("_base"))
    kept = F.least(F.col("shared"), F.coalesce("_base", F.lit(0).cast("long")))
    convs = settle(
        lengths.withColumns({"family": family.cast("long"), "shared": shared.cast("long")})
        .join(of_family, "family", "left").withColumn("kept", kept)
        .withColumn("total", F.col("kept") + F.greatest(
            F.col("length") - F.col("shared"), F.lit(0).cast("long")))
        .select("conv", "family", "shared", "kept", "total"))

    own = (placed.where(F.col("pos") > shared).join(convs, "conv")
           .withColumn("depth", F.col("pos") - F.col("shared") + F.col("kept")))
    start = placed.where((F.col("conv") == family) & (F.col("pos") <= most_shared)).select(
        F.col("conv").alias("family"), F.col("pos").alias("depth"), "key", "bytes")
    taken = convs.where(F.col("kept") > 0).join(start, "family").where(
        F.col("depth") <= F.col("kept"))
    columns = ["conv", "family", "depth", "key", "bytes",
               (F.col("depth") == F.col("total")).alias("last")]
    return convs, own.select(*columns).unionByName(taken.select(*columns))


def _shard(family: Column, segment: Column, n_shards: int) -> Column:
    return F.pmod(F.xxhash64(family, segment), F.lit(n_shards)).cast("int")


def _segment(depth: Column, length: int) -> Column:
    return F.floor((F.greatest(depth, F.lit(1)) - 1) / F.lit(length)).cast("long")


def _wrapped(low: Column, high: Column) -> Column:
    """Two sums of 32-bit halves as one sum modulo 2^64."""
    carried = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


# --- inside a shard -------------------------------------------------------------------------

_ROW = "shard int, conv long, segment long, depth long, a long, b long, bytes long, last boolean, header boolean"
_LOCAL = ("shard int, a long, b long, depth long, up_a long, up_b long, hung boolean, "
          "bytes long, n long, conv long, inner boolean, ends array<long>")
_SUMS = ("a long, b long, n_leaves long, saved_tokens long, n_children long, conv long, "
         "depth long, n_convs long, parent long")


def _column(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    values = table[name].combine_chunks().to_numpy(zero_copy_only=False)
    return values.astype(kind, copy=False)


def _keys(table: pa.Table, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_column(table, c).astype(np.int64).view(np.uint64) for c in (a, b))


def local_nodes(table: pa.Table) -> pa.Table:
    """The distinct nodes of a shard's rows with the shard's counts.

    A run of rows (one segment of a conversation) starts with its header, the node it hangs
    from; a header counts as a member of its node only at the root.
    """
    conv, segment, depth = (_column(table, c) for c in ("conv", "segment", "depth"))
    order = np.lexsort((depth, segment, conv))
    conv, depth = conv[order], depth[order]
    header = _column(table, "header", bool)[order]
    last, bytes_ = _column(table, "last", bool)[order], _column(table, "bytes")[order]
    run = np.cumsum(header) - 1
    first = np.flatnonzero(header)[run]
    keys = []
    for lane in _keys(table, "a", "b"):
        lane = lane[order]
        with np.errstate(over="ignore"):
            total = np.cumsum(lane, dtype=np.uint64)
            keys.append(total - total[first] + lane[first])
    a, b = keys
    slots = SlotTable(*distinct_keys(a, b))
    at, n = slots.find(a, b), len(slots)

    member = ~header | (depth == 0)
    counts = np.bincount(at[member], minlength=n)
    smallest = np.full(n, _NOBODY)
    np.minimum.at(smallest, at[member], conv[member])
    inner, hung = np.zeros(n, bool), np.zeros(n, bool)
    inner[at[member & ~last]] = True
    deep, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    deep[at], size[at[~header]] = depth, bytes_[~header]
    up_a, up_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    below = np.flatnonzero(~header)
    hung[at[below]] = True
    up_a[at[below]], up_b[at[below]] = a[below - 1], b[below - 1]

    ended = np.flatnonzero(last & member)
    ended = ended[np.lexsort((conv[ended], at[ended]))]
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(at[ended], minlength=n), out=offsets[1:])
    ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(conv[ended]))
    shard = np.full(n, table["shard"][0].as_py(), np.int32)
    return pa.table({
        "shard": shard, "a": slots.a.view(np.int64), "b": slots.b.view(np.int64), "depth": deep,
        "up_a": up_a.view(np.int64), "up_b": up_b.view(np.int64), "hung": hung, "bytes": size,
        "n": counts.astype(np.int64), "conv": pa.array(smallest, mask=smallest == _NOBODY),
        "inner": inner, "ends": ends})


def accumulate(table: pa.Table, segment: int) -> pa.Table:
    """Sums over the subtrees inside a shard, and the nodes that belong to it.

    Rows with ``extra`` add what hangs from the end of a segment; sums stop at the node a later
    segment hangs from, since they reach its ancestors as ``extra``.
    """
    extra = _column(table, "extra", bool)
    more, table = table.filter(pa.array(extra)), table.filter(pa.array(~extra))
    a, b = _keys(table, "a", "b")
    slots = SlotTable(a, b)
    n, at = len(slots), slots.find(a, b)

    def put(name: str, kind=np.int64) -> np.ndarray:
        out = np.zeros(n, kind)
        out[at] = _column(table, name, kind)
        return out

    depth, conv, n_convs = put("depth"), put("conv"), put("n_convs")
    owned, hung = put("owned", bool), put("hung", bool)
    up = np.full(n, -1)
    up[at] = slots.find(*_keys(table, "up_a", "up_b"))
    up[~hung] = -1
    leaves = (owned & ~put("inner", bool)).astype(np.int64)
    saved = np.where(owned, (n_convs - 1) * put("bytes"), 0)
    if more.num_rows:
        end = slots.find(*_keys(more, "a", "b"))
        np.add.at(leaves, end, _column(more, "n_leaves"))
        np.add.at(saved, end, _column(more, "saved_tokens"))

    passes = (up >= 0) & ((depth == 1) | ((depth - 1) % segment != 0))
    by_depth = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in reversed(np.split(by_depth, edges)):
        level = level[passes[level]]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    children = np.zeros(n, np.int64)
    np.add.at(children, up[owned & hung], 1)

    say = owned | (leaves != 0) | (saved != 0) | (children != 0)
    parent = pa.array(conv[up], mask=up < 0)
    columns = {"a": slots.a.view(np.int64), "b": slots.b.view(np.int64), "n_leaves": leaves,
               "saved_tokens": saved, "n_children": children}
    out = {k: pa.array(v) for k, v in columns.items()}
    out |= {k: pa.array(v, mask=~owned) for k, v in
            (("conv", conv), ("depth", depth), ("n_convs", n_convs))}
    return pa.table(out | {"parent": parent}).filter(pa.array(say))


# --- digests of long lists ------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined into pieces of bounded length with their node and first id."""
    node, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"a": [node[0]], "b": [node[1]], "first": [ids[0]],
             "ids": [",".join(map(str, ids))]}, _PIECES)

    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("a", "b", "conv")))
        for a, b, conv in rows:
            if ids and ((a, b) != node or size >= PIECE):
                yield piece()
                ids, size = [], 0
            node = (a, b)
            ids.append(conv)
            size += len(str(conv)) + 1
    if ids:
        yield piece()


_PIECES = pa.schema({"a": pa.int64(), "b": pa.int64(), "first": pa.int64(), "ids": pa.string()})
_HASHES = pa.schema({"a": pa.int64(), "b": pa.int64(), "ends_sha256": pa.string()})


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its pieces in order; no list is held as a whole."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for a, b, ids in zip(*(batch[c].to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=_HASHES)
    if node is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (*node, state.hexdigest())], schema=_HASHES)


def hash_ids(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)``: SHA-256 of each node's ids, ascending and joined by commas.

    Ids are sorted in range parts and joined into pieces there; the task that hashes a node
    reads its pieces one after the other.  (A single SHA-256 cannot be split further.)
    """
    ordered = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    pieces = ordered.mapInArrow(_pieces, "a long, b long, first long, ids string")
    return (pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
            .mapInArrow(_hash_pieces, "a long, b long, ends_sha256 string"))


# --- the trie ---------------------------------------------------------------------------------

def prefix_trie(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie over ``rebuilt`` conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``: smallest member, turns, the parent's smallest member (NULL at the root),
    members, children, childless nodes of the subtree, bytes that need no second copy in the
    subtree, and the digest of the ids that end at the node.  No conversations have no node.
    """
    spark = convs.sparkSession
    n_rows, longest = convs.agg(
        F.sum(F.col("total") + 1 + F.floor(F.col("total") / F.lit(segment))),
        F.max("total")).first()
    n_shards = max(1, -(-int(n_rows or 0) // shard_rows))
    lanes = {"a": F.xxhash64("depth", "key"), "b": F.xxhash64("key", F.lit("b"), "depth")}
    steps = turns.withColumn("segment", _segment(F.col("depth"), segment)).withColumns(lanes)
    zero = F.lit(0).cast("long")
    headers = convs.select("conv", "family", zero.alias("segment"), zero.alias("a"),
                           zero.alias("b"), (F.col("total") == 0).alias("last"))
    later = None
    if (longest or 0) > segment:
        long_ones = convs.where(F.col("total") > segment).select("conv")
        halves = {f"{c}_{h}": F.sum(v) for c in "ab" for h, v in (
            ("low", F.col(c).bitwiseAND(F.lit(_LOW))), ("high", F.shiftrightunsigned(c, 32)))}
        sums = (steps.join(long_ones, "conv", "left_semi").groupBy("conv", "family", "segment")
                .agg(*[v.alias(k) for k, v in halves.items()]))
        before = Window.partitionBy("conv").orderBy("segment").rowsBetween(
            Window.unboundedPreceding, -1)
        later = settle(sums.select("conv", "family", "segment", *[
            _wrapped(F.sum(f"{c}_low").over(before), F.sum(f"{c}_high").over(before)).alias(c)
            for c in "ab"]).where(F.col("segment") > 0))
        headers = headers.unionByName(later.withColumn("last", F.lit(False)))
    rows = steps.select("conv", "family", "segment", "depth", "a", "b", "bytes", "last",
                        F.lit(False).alias("header")).unionByName(
        headers.select("conv", "family", "segment", (F.col("segment") * segment).alias("depth"),
                       "a", "b", zero.alias("bytes"), "last", F.lit(True).alias("header")))
    dealt = rows.withColumn("shard", _shard(F.col("family"), F.col("segment"), n_shards))
    local = settle(dealt.select([f.split()[0] for f in _ROW.split(", ")])
                   .groupBy("shard").applyInArrow(local_nodes, _LOCAL))

    nodes = settle(local.groupBy("a", "b").agg(
        F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes"),
        F.max("inner").alias("inner"), F.max("depth").alias("depth")))
    families = convs.select("conv", "family")
    facts = nodes.join(families, "conv").withColumn(
        "owner", _shard(F.col("family"), _segment(F.col("depth"), segment), n_shards))
    known = local.select("shard", "a", "b", "up_a", "up_b", "hung").join(
        facts.select("a", "b", "n_convs", "conv", "bytes", "inner", "depth", "owner"), ["a", "b"])
    inputs = known.withColumn("owned", F.col("owner") == F.col("shard")).drop("owner").withColumns(
        {"extra": F.lit(False), "n_leaves": zero, "saved_tokens": zero})
    if later is not None:
        inputs = inputs.unionByName(_extras(nodes, later, segment, n_shards),
                                    allowMissingColumns=True)
    sums = inputs.groupBy("shard").applyInArrow(lambda t: accumulate(t, segment), _SUMS)
    totals = sums.groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")],
        *[F.max(c).alias(c) for c in ("conv", "depth", "n_convs")],
        F.max(F.when(F.col("conv").isNotNull(), F.col("parent"))).alias("parent"))
    ends = hash_ids(local.select("a", "b", F.explode("ends").alias("conv")))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return (totals.join(ends, ["a", "b"], "left")
            .select(F.col("conv").alias("conv_id"), "depth",
                    F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256")))


def _extras(nodes: DataFrame, later: DataFrame, segment: int, n_shards: int) -> DataFrame:
    """What the later segments of long conversations add at the end of each earlier one."""
    values = (nodes.withColumn("segment", _segment(F.col("depth"), segment))
              .groupBy("conv", "segment").agg(
                  F.sum((~F.col("inner")).cast("long")).alias("n_leaves"),
                  F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")))
    onwards = Window.partitionBy("conv").orderBy("segment").rowsBetween(
        0, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    return later.join(values, ["conv", "segment"], "left").select(
        _shard(F.col("family"), F.col("segment") - 1, n_shards).alias("shard"), "a", "b",
        *[F.sum(F.coalesce(c, zero)).over(onwards).alias(c)
          for c in ("n_leaves", "saved_tokens")], F.lit(True).alias("extra"))
