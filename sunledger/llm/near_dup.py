"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles, the weight being the number of
occurrences.  The region of a shingle of weight w is w wide and reaches along the rank axis;
hashed darts fall on it as a Poisson process, so two documents with a shingle in common see
the same darts where both weights reach.  Every dart names one of ``K`` coordinates, and a
coordinate keeps its earliest dart: two documents agree there with a probability equal to
their weighted Jaccard similarity.  Only about ``K ln K`` darts are thrown per document.

Signatures are banded.  In a band's bucket documents are compared exactly with the bucket's
hub.  Where a bucket then still holds several classes, their members are paired once more by
the rarest shingles of each text; a pair without a common one there is proven to be less than
0.8 similar, all others are compared exactly.  So no link between two texts of different
classes is lost, and the members of one class are never expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sunledger.llm.common import mix, slices, string_bytes, word_hashes
from sunledger.session import settle

SHINGLE, THRESHOLD = 5, 0.8
#: a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6
BANDS, ROWS = 32, 5
K = BANDS * ROWS
_SEEDS = np.array([0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1) for i in range(8)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_hashes(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the row of each.

    A text of fewer words, but not none, is one shingle.
    """
    words, rows = word_hashes(*string_bytes(column))
    counts = np.bincount(rows, minlength=len(column)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            out += words[k:k + len(out)] * _ODD[k % len(_ODD)]
        whole = rows[:len(out)] == rows[size - 1:] if len(out) else np.zeros(0, bool)
        hashes, owner = mix(out[whole]), rows[:len(out)][whole]
        short = np.flatnonzero((counts > 0) & (counts < size))
        extra = np.array([int(np.sum(words[first[r]:first[r] + counts[r]]
                                     * _ODD[:counts[r]] + _SEEDS[5])) & (2**64 - 1)
                          for r in short], np.uint64)
        hashes = np.concatenate((hashes, mix(extra ^ _SEEDS[6])))
    owner = np.concatenate((owner, short))
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _occurrences(hashes: np.ndarray, owner: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles sorted by row and hash, their rows, and how many equal ones precede each."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    return h, o, np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))


def dart_signatures(hashes: np.ndarray, owner: np.ndarray, n_rows: int,
                    k: int = K) -> np.ndarray:
    """Earliest dart of every coordinate: its rank, unique to the dart; rows x k.

    A shingle that occurs w times has the unit-wide slabs 0 to w-1 of its region; the darts
    of a slab come one by one along the rank axis, at exponential gaps.
    """
    sig = np.full((n_rows, k), np.inf)
    if not len(hashes):
        return sig
    h, o, copy = _occurrences(hashes, owner)
    with np.errstate(over="ignore"):
        slab = mix(h + mix(copy.astype(np.uint64) * _SEEDS[0] + _SEEDS[1]))
    weight = np.bincount(o, minlength=n_rows).astype(np.float64)
    reach = k * (np.log(k) + 2.0)  # darts thrown per document on the first attempt
    todo = weight > 0
    while todo.any():
        limit = np.where(todo, reach / np.maximum(weight, 1.0), 0.0)
        live = todo[o]
        s, row, far = slab[live], o[live], limit[o[live]]
        rank, i = np.zeros(len(s)), 0
        sig[todo] = np.inf
        while len(s):
            i += 1
            with np.errstate(over="ignore"):
                dart = mix(s + np.uint64(i) * _SEEDS[2])
                rank = rank - np.log(_unit(dart))
                inside = rank <= far
                s, row, far, rank, dart = (x[inside] for x in (s, row, far, rank, dart))
                at = (mix(dart ^ _SEEDS[3]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(sig.reshape(-1), row * k + at, rank)
        todo &= np.isinf(sig).any(axis=1)  # some coordinate got no dart: throw further
        reach *= 2.0
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = sig.view(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        out = np.full((len(sig), bands), _SEEDS[4], np.uint64)
        for r in range(rows):
            out = mix(out * _ODD[r % len(_ODD)] + values[:, :, r])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays of shingle hashes with repetitions."""
    if not len(a) or not len(b):
        return 0.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(nx[i], ny[j]).sum())
    return common / (len(a) + len(b) - common)


def sign_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, digest of the text and its band keys (none for a text without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                hashes, owner = shingle_hashes(piece["_text"])
                keys = band_keys(dart_signatures(hashes, owner, piece.num_rows))
                some = np.bincount(owner, minlength=piece.num_rows) > 0
                bands = pa.array([k if s else [] for k, s in zip(keys, some)],
                                 pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece["_key"], piece["_digest"], bands],
                                                 names=["key", "digest", "bands"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.md5(F.col(text).cast("binary")).alias("_digest"),
                       F.col(text).alias("_text")).mapInArrow(
        run, f"key {kind}, digest string, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar."""
    both = (pairs.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("_tb")), "b")
            .join(texts.select(F.col("digest").alias("a"), F.col("text").alias("_ta")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_tb"):
                ok = []
                ha, oa = shingle_hashes(piece["_ta"])
                hb, ob = shingle_hashes(piece["_tb"])
                n = np.arange(piece.num_rows + 1)
                ea, eb = np.searchsorted(oa, n), np.searchsorted(ob, n)
                for r in range(piece.num_rows):
                    ok.append(similarity(ha[ea[r]:ea[r + 1]], hb[eb[r]:eb[r + 1]]) >= THRESHOLD)
                yield pa.RecordBatch.from_arrays([piece["a"], piece["b"], pa.array(ok)],
                                                 names=["a", "b", "linked"])
    return both.select("a", "b", "_ta", "_tb").mapInArrow(
        run, "a string, b string, linked boolean")


def connect(links: DataFrame) -> DataFrame:
    """Smallest node of the component of every node that has a link.

    Labels spread along links and are then shortened to their label's label; each round is
    written out, so lineage stays short and lost executors cost no earlier round.
    """
    edges = settle(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(
        links.select("b", "a")).distinct())
    labels = settle(edges.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(
            F.col("x").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = settle(spread.join(up, "label", "left").select(
            "node", "old", F.coalesce(F.least("up", "label"), "label").alias("label")))
        labels = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest, class`` per row.

    Equal texts are one node, named by their digest; the class is the smallest digest of the
    component.  A text without words links to nothing but equal texts; a NULL text has no
    digest and no class.  Repeated rows and NULL keys are kept; ties do not occur.  Only links
    that can join classes are tried, so the links themselves are no result.
    """
    signed = settle(sign_texts(docs, key, text))
    nodes = (signed.where((F.size("bands") > 0) & F.col("digest").isNotNull())
             .groupBy("digest").agg(F.first("bands").alias("bands")))
    buckets = settle(_buckets(nodes))
    texts = settle(
        docs.select(F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("digest"))
        .join(buckets.select("digest").distinct(), "digest")
        # one row per text, equal texts are merged before they are sent
        .groupBy("digest").agg(F.max("text").alias("text")))

    tried = settle(_verify(buckets.where("digest <> hub").select(
        F.least("hub", "digest").alias("a"), F.greatest("hub", "digest").alias("b")).distinct(),
        texts))
    divided = _divided(buckets, connect(tried.where("linked")))
    more = settle(_prefix_pairs(divided, texts).join(tried, ["a", "b"], "left_anti"))
    links = settle(tried.union(_verify(more, texts)).where("linked").select("a", "b"))
    labels = connect(links)
    return signed.select("key", "digest").join(
        labels.withColumnRenamed("node", "digest"), "digest", "left").select(
        "key", "digest", F.coalesce("label", "digest").alias("class"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """Members of every bucket with more than one text, and the bucket's hub.

    The hub is the member with most company over all its buckets, which is the text that
    the others were copied from if there is one; ties go to the smaller digest.
    """
    members = nodes.select("digest", F.posexplode("bands").alias("band", "k"))
    crowded = members.groupBy("band", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(members.join(crowded, ["band", "k"]))
    company = shared.groupBy("digest").agg(F.sum("n").alias("company"))
    hubs = shared.join(company, "digest").groupBy("band", "k").agg(
        F.min(F.struct(-F.col("company"), "digest"))["digest"].alias("hub"))
    return shared.join(hubs, ["band", "k"]).select("band", "k", "digest", "hub")


def _divided(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and class of the members of buckets that still hold more than one class."""
    named = buckets.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "label", F.coalesce("label", "digest"))
    mixed = named.groupBy("band", "k").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi")
    return settle(named.join(mixed.select("band", "k"), ["band", "k"], "left_semi")
                  .select("digest", "label").distinct())


def _elements(texts: DataFrame) -> DataFrame:
    """One row per shingle and occurrence of a text: ``digest, size, element``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                h, o, copy = _occurrences(*shingle_hashes(piece["text"]))
                size = np.bincount(o, minlength=piece.num_rows)
                with np.errstate(over="ignore"):
                    element = mix(h ^ mix(copy.astype(np.uint64) * _SEEDS[7] + _SEEDS[5]))
                yield pa.RecordBatch.from_arrays(
                    [piece["digest"].take(pa.array(o)), pa.array(size[o]),
                     pa.array(element.view(np.int64))], names=["digest", "size", "element"])
    return texts.select("digest", "text").mapInArrow(run, "digest string, size long, element long")


def _prefix_pairs(divided: DataFrame, texts: DataFrame) -> DataFrame:
    """Every pair (a, b) of different classes that can still be similar.

    Texts of x and y shingles with similarity 0.8 have at least 4/9 (x + y) in common.  So,
    in one order of all shingles, rarest first, the first x - 4/9 (x + y) + 1 shingles of
    one and the first y - 4/9 (x + y) + 1 of the other share one: a pair that shares none
    there is proven not to be linked.  Shingles held by one class only are set aside, and
    classes are paired before their members, so members of one class never meet here.
    """
    held = settle(_elements(texts.join(divided, "digest", "left_semi")))
    often = held.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("digest").orderBy("n", "element")
    first = (held.join(often, "element").withColumn("r", F.row_number().over(order))
             # the other text has at least 4/5 of the shingles
             .where("5 * (r - 1) <= size").where("n > 1")
             .join(divided, "digest").select("element", "label", "digest", "size", "r"))
    mixed = first.groupBy("element").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi")
    # the largest text that a shingle at this place can still find: 9 (x - r + 1) >= 4 (x + y)
    first = settle(first.join(mixed.select("element"), "element", "left_semi").withColumn(
        "most", F.expr("(5 * size - 9 * (r - 1)) / 4")))
    sides = first.groupBy("element", "label").agg(
        F.min("size").alias("least"), F.max("most").alias("most"))
    la, lb = (sides.select("element", *(F.col(c).alias(c + e) for c in ("label", "least", "most")))
              for e in ("_p", "_q"))
    classes = la.join(lb, "element").where(
        "label_p < label_q and most_p >= least_q and most_q >= least_p")
    x, y = (first.select("element", F.col("label").alias("label" + e), F.col("digest").alias(d),
                         F.col("size").alias("size" + e), F.col("most").alias("reach" + e))
            for e, d in (("_p", "a"), ("_q", "b")))
    found = classes.join(x, ["element", "label_p"]).where(
        "reach_p >= least_q and most_q >= size_p").join(y, ["element", "label_q"]).where(
        "reach_p >= size_q and reach_q >= size_p")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key and ``class_id`` (smallest key of the class).

    NULL texts are classes of their own.
    """
    classes = similar_classes(docs, key, text)
    ids = classes.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("key").alias("class_id"))
    return classes.join(ids, "class", "left").select(
        F.col("key").alias(key),
        F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of every class; NULL texts are all kept.

    The row with the smallest (key, digest) of its class stays; of rows with the same key and
    text the first by the JSON of their other columns.  Columns keep their names and values.
    """
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    classes = similar_classes(docs, key, text)
    docs = docs.toDF(*own)
    key, text = own[names.index(key)], own[names.index(text)]
    others = [c for c in own if c not in (key, text)]
    best = classes.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min(F.struct(F.col("key").alias("_k"), F.col("digest").alias("_d"))).alias("w")
    ).select("w._k", "w._d")
    marked = docs.withColumn("_digest", F.md5(F.col(text).cast("binary")))
    same = marked[key].eqNullSafe(best["_k"]) & (marked["_digest"] == best["_d"])
    kept = marked.join(best, same, "left_semi")
    rank = F.to_json(F.struct(*others)) if others else F.lit(0)
    one = kept.withColumn("_n", F.row_number().over(
        Window.partitionBy(key, "_digest").orderBy(rank))).where("_n = 1")
    return one.select(own).union(docs.where(F.col(text).isNull())).toDF(*names)
