"""Exact top-k inner products over vectors grouped by length.

Candidates fall into buckets of similar length (a fixed ratio), large buckets into blocks of
bounded size.  A query starts with the k-th score it reaches among the longest vectors.  In
a block that score gives a local cosine threshold ``t / (|q| l)``, ``l`` being the longest
length in the block: above 1 the block is skipped; a high threshold prunes by coordinates
(a candidate's direction must lie in the range that the query's strongest coordinates
allow); a low one prunes by length alone.  Survivors are verified by exact integer products.

Queries travel in blocks and meet candidate blocks by an equi-join on the query block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sunledger.session import settle

K, SCALE, QUERY_STEP = 20, 64, 20
#: rows of a candidate block, of a query block, and of the longest vectors seen first
BLOCK_ROWS, QUERY_ROWS, WARM_ROWS = 4096, 2048, 2048
#: ratio of lengths within a bucket; cosine from which coordinates are used; how many
BUCKET_RATIO, COORDINATE_COSINE, FOCUS = 1.1, 0.6, 3
_EPS = 1e-9


def quantised(vector: Column) -> Column:
    """Integer components ``floor(64 x)``; NULL if any component is missing or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(
        vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    peak = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if peak < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


class Block:
    """Candidates of one block, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.unit = self.vectors / np.maximum(self.length, _EPS)[:, None]

    def search(self, query: np.ndarray, own: int, floor: float, k: int
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best that reach ``floor``."""
        size = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        chosen = np.arange(len(self.ids))
        if floor > 0:
            top = float(self.length[0]) * size
            cosine = floor / top if top > 0 else np.inf
            if cosine > 1 + 1e-9:
                return self.ids[:0], np.zeros(0, np.int64)
            # candidates shorter than this cannot reach the floor
            n = int(np.searchsorted(-self.length, -(floor / size) * (1 - 1e-9), side="right"))
            chosen = chosen[:n]
            if cosine >= COORDINATE_COSINE and n:
                direction = query / size
                room = np.sqrt(max(0.0, 1 - min(cosine, 1.0) ** 2))
                for f in np.argsort(-np.abs(direction))[:FOCUS]:
                    q = float(direction[f])
                    rest = np.sqrt(max(0.0, 1 - q * q)) * room
                    # directions within the angle of the query: cosine at least the threshold
                    low, high = q * cosine - rest - 1e-6, q * cosine + rest + 1e-6
                    if q >= cosine:
                        high = 1.0 + 1e-6
                    if -q >= cosine:
                        low = -1.0 - 1e-6
                    u = self.unit[chosen, f]
                    chosen = chosen[(u >= low) & (u <= high)]
        chosen = chosen[self.ids[chosen] != own]
        scores = products(query[None, :], self.vectors[chosen])[0]
        if np.isfinite(floor):
            reach = scores >= floor
            chosen, scores = chosen[reach], scores[reach]
        pick = best(scores, self.ids[chosen], k)
        return self.ids[chosen][pick], scores[pick]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list array as a matrix; shorter vectors are filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.int64)
    out = np.zeros((len(column), dim), np.int64)
    where = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[where, at] = flat
    return out


def _blocks(df: DataFrame, key: list, out: str, dim: int, columns: list[str]) -> DataFrame:
    """Rows gathered into blocks: one list per column, vectors filled up and chained."""
    filled = F.concat(F.col("v"), F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    return df.withColumn("v", filled).groupBy(*key).agg(
        F.collect_list(F.struct(*columns, "v")).alias("_rows")).select(
        *key, *[F.col(f"_rows.{c}").alias(f"{out}_{c}") for c in columns],
        F.flatten("_rows.v").alias(f"{out}_v"))


def _search(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: np.asarray(batch[c][r].values)
                block = Block(get("c_id"), get("c_v").reshape(-1, dim))
                queries, own, row, floor = (get("q_v").reshape(-1, dim), get("q_id"), get("q_row"),
                                            get("q_floor"))
                found = [block.search(q, i, t, k) for q, i, t in zip(queries, own, floor)]
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, sizes), pa.int64()),
                     pa.array(np.repeat(row, sizes), pa.int64()),
                     pa.array(np.concatenate([i for i, _ in found]), pa.int64()),
                     pa.array(np.concatenate([s for _, s in found]), pa.int64())],
                    names=["query_id", "row", "vec_id", "score"])
    return pairs.mapInArrow(run, "query_id long, row long, vec_id long, score long")


def search(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """The k best candidates of every query row, with rank, id and exact score.

    Queries are the rows whose id is divisible by ``step``, candidates all rows with another
    id.  Rows with a NULL id, a NULL vector or a NULL or non-finite component take no part;
    an empty vector has score 0 with all; vectors of different dimension are filled up with
    zeros.  Ties go to the smaller id.  Repeated rows are candidates of their own, and a
    repeated query is answered once per row.  Other columns are left out.
    """
    spark = vectors.sparkSession
    whole = settle(vectors.select(F.col(vec_id).cast("long").alias("id"),
                                  quantised(F.col(vector)).alias("v"),
                                  F.monotonically_increasing_id().alias("row"))
                   .where("id is not null and v is not null")
                   .withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast(
                       "double") * x.cast("double"))))
    facts = whole.agg(F.max(F.size("v")).alias("dim"), F.count_if(
        F.col("id") % step == 0).alias("queries")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["queries"]:
        return empty
    dim = max(1, facts["dim"])
    n_query_blocks = -(-facts["queries"] // QUERY_ROWS)

    bucket = F.floor(F.log(F.greatest("n2", F.lit(1.0))) / float(2 * np.log(BUCKET_RATIO)))
    placed = whole.withColumn("bucket", bucket)
    # one row per length bucket
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    blocks = _blocks(placed.join(F.broadcast(sizes), "bucket").withColumn(
        "part", F.pmod(F.xxhash64("id", "row"), "parts")), ["bucket", "part"], "c", dim, ["id"])
    queries = whole.where(F.col("id") % step == 0).withColumn(
        "qb", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(n_query_blocks)))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long")))
    longest = whole.orderBy(F.desc("n2"), "row").limit(WARM_ROWS)
    warm = _blocks(longest.withColumn("part", F.lit(0)), ["part"], "c", dim, ["id"])
    start = _blocks(queries.withColumn("floor", F.lit(float("-inf"))), ["qb"], "q", dim,
                    ["id", "row", "floor"])
    reached = settle(_search(warm.withColumn("qb", every).join(start, "qb"), dim, k))
    floors = reached.groupBy("row").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    ready = queries.join(floors, "row", "left").withColumn("floor", F.when(
        F.col("n") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf"))))
    packed = _blocks(ready, ["qb"], "q", dim, ["id", "row", "floor"])
    found = _search(blocks.withColumn("qb", every).join(packed, "qb")
                    .repartition(F.col("bucket"), F.col("part"), F.col("qb")), dim, k)
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
