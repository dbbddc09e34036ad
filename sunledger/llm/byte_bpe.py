"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut by the vocabulary's pattern into words.  A word is read as an array of bytes
and ``aggregate`` folds the ranked merges over it: every round joins the leftmost adjacent
pair of lowest rank until no pair has one.  Ranks stand in a literal map, laid out in buckets
by crc32, so that a look-up reads one very short map.  The literal is written once, to the
shared folder, and jobs take it from there as a scalar: no plan holds its text.

Bytes are written as the characters U+0000 to U+00FF (``ISO-8859-1``), so that a piece of
bytes is a string, and decoding is the concatenation of the pieces of the ids.

Spark folds each frequent distinct word once (a memo of bounded size, counted on the executors,
that never changes a result).  Texts are split and looked up in the memo in Arrow batches; a word
beyond it is handed back to Spark, which folds the distinct ones of each text with the same
higher-order functions and puts the ids together.  Only a word above ``HEAP_FROM`` bytes is merged
in the batch, over linked pieces and a heap: a fold's rounds take time with the square of its length.
No text is shuffled, and the driver holds the memo as Arrow bytes only.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sunledger.llm.common import slices
from sunledger.session import settle

#: fixed value: the split of the multilingual rank file, with Unicode white space for Java
_SPACE = r"\p{IsWhite_Space}"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
           rf"|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+")
NO_RANK = 2_147_483_647
#: distinct words in the memo, and about how many documents they are counted in
HEAD_WORDS, HEAD_DOCS = 200_000, 20_000
#: head words are at most this long, so the memo is bounded in bytes too
HEAD_BYTES = 64
#: bytes above which a word is merged by a heap
HEAP_FROM = 256
#: bits of a byte's place in the fold's state
START_BITS = 24


def _ranked(data: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(piece): int(rank) for piece, rank in lines}


def read_ranks(path: str) -> dict[str, int]:
    """Piece (bytes as ISO-8859-1 characters) -> rank, from a tiktoken rank file."""
    return {p.decode("latin-1"): r for p, r in _ranked(Path(path).read_bytes()).items()}


def _buckets(n_keys: int) -> int:
    return max(1, n_keys)


def literal_map(entries: dict[str, int]) -> Column:
    """The entries as a literal array of maps; an entry is in the map of its crc32."""
    n = _buckets(len(entries))
    table: list[dict] = [{} for _ in range(n)]
    for key, value in entries.items():
        table[zlib.crc32(key.encode()) % n][key] = value
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def stored_literals(spark: SparkSession, ranks: dict[str, int]) -> DataFrame:
    """One row: the rank map, and the piece of every id (empty for an id without one)."""
    by_id = {r: p for p, r in ranks.items()}
    pieces = [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]
    return settle(spark.range(1).select(
        literal_map(ranks).alias("ranks"),
        F.from_json(F.lit(json.dumps(pieces)), "array<string>").alias("pieces")))


def unused(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def with_scalar(df: DataFrame, row: DataFrame, out: str, body) -> DataFrame:
    """``out`` = ``body`` of the struct of a one-row table's columns.

    The row is read once and handed to the tasks in one piece.  It is used at one place, so the
    optimizer moves the subquery into the expression and no row carries it.
    """
    name = unused("held", df)
    held = df.select("*", row.select(F.struct("*")).scalar().alias(name))
    kept = [c for c in df.columns if c != out]
    return held.select(*[F.col(f"`{c}`") for c in kept], let(F.col(name), body).alias(out))


def look_up(table: Column, key: Column, n_keys: int) -> Column:
    """Value of a key, NULL if it has none; ``n_keys`` is the size of the literal map."""
    slot = F.crc32(key.cast("binary")) % _buckets(n_keys)
    return F.try_element_at(F.get(table, slot.cast("int")), key)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: Column, n_ranks: int) -> Column:
    """Ids of one word given as ISO-8859-1 characters.

    The state holds a number per piece: the rank of the pair it begins, then its first byte, so
    that the least number is the leftmost pair of lowest rank; a round joins one pair.
    """
    def folded(w: Column) -> Column:
        size = F.length(w)

        def piece(start: Column, end: Column) -> Column:
            return look_up(ranks, F.substring(w, start + 1, end - start), n_ranks)

        def state(rank: Column, start: Column) -> Column:
            return F.shiftleft(F.coalesce(rank, F.lit(NO_RANK)).cast("long"), START_BITS).bitwiseOR(
                start.cast("long"))

        def first(entry: Column) -> Column:
            return F.coalesce(entry.bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int"), size)

        def join(s: Column, low: Column) -> Column:
            def joined(at: Column) -> Column:
                before, start = first(F.get(s, at - 2)), first(low)
                end, after = first(F.get(s, at + 1)), first(F.get(s, at + 2))
                new = F.struct(
                    state(F.when(end < size, piece(start, after)), start).alias("pair"),
                    F.when(at > 1, state(piece(before, end), before)).alias("left"))
                return let(new, lambda n: F.transform(
                    F.filter(s, lambda _, i: i != at),
                    lambda e, i: F.when(i == at - 1, n["pair"]).when(
                        i == at - 2, n["left"]).otherwise(e)))
            return let(F.array_position(s, low).cast("int"), joined)

        def step(s: Column, _: Column) -> Column:
            return let(F.array_min(s), lambda low: F.when(
                F.shiftright(low, START_BITS) < NO_RANK, join(s, low)).otherwise(s))

        begin = F.transform(F.sequence(F.lit(0), size - 1), lambda i: state(
            F.when(i < size - 1, piece(i, i + 2)), i))
        return F.aggregate(F.sequence(F.lit(1), size - 1), begin, step, lambda s: F.transform(
            s, lambda e, i: piece(first(e), first(F.get(s, i + 1)))))

    def ids(w: Column) -> Column:
        return let(look_up(ranks, w, n_ranks), lambda whole: F.when(
            whole.isNotNull(), F.array(whole)).otherwise(folded(w)))

    return let(word, ids)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the leftmost pair of lowest rank is joined until no pair has one."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > HEAP_FROM:
        return merge_long(word, ranks)
    get, cuts = ranks.get, list(range(len(word) + 1))
    pairs = [get(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < NO_RANK:
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[cuts[i]:cuts[i + 2]], NO_RANK)
        if i:
            pairs[i - 1] = get(word[cuts[i - 1]:cuts[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length: the same merges, by a heap over linked pieces."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    gone = bytearray(n + 1)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if gone[i] or middle >= n or gone[middle] or ends[middle] != end:
            continue
        ends[i], gone[middle], before[end] = end, 1, i
        for lo, hi in ((before[i], end), (i, ends[end] if end < n else 0)):
            if 0 <= lo < hi and (r := ranks.get(word[lo:hi])) is not None:
                heapq.heappush(heap, (r, lo, hi))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return ids


def as_bytes(word: Column) -> Column:
    """A word's UTF-8 bytes, written as ISO-8859-1 characters."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def words_of(text: Column) -> Column:
    """The pattern's matches; together they are the whole text.  NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def head_words(docs: DataFrame, literals: DataFrame, n_ranks: int, text: str = "text",
               n_words: int = HEAD_WORDS, n_docs: int = HEAD_DOCS) -> DataFrame:
    """``(w, ids)`` of frequent distinct words that are no piece themselves.

    They are counted in the documents of a share of all text digests that holds about
    ``n_docs``; only counts are shuffled.  The memo saves work and has no influence on any
    result, since words outside of it are folded alike, text by text.
    """
    share = max(1, docs.count() // n_docs)
    counted = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0)
    words = counted.select(F.explode(words_of(F.col(text))).alias("w")).groupBy("w").count()
    bound = words.where((F.octet_length("w") <= HEAD_BYTES) & (F.col("count") > 1)).orderBy(
        F.desc("count"), "w").limit(n_words).select("w")
    folded = with_scalar(settle(bound).repartition(16), literals, "ids", lambda held: fold_merges(
        as_bytes(F.col("w")), held["ranks"], n_ranks))
    return settle(folded).where(F.size("ids") > 1)


@lru_cache(maxsize=4)
def _pattern(source: str):
    return regex.compile(source)


@lru_cache(maxsize=2)
def _memo(folded: bytes, rank_file: bytes) -> tuple[dict[str, list[int]], dict[bytes, int]]:
    """Ids of every piece that is a text and of the folded words, and all ranks."""
    ranks = _ranked(rank_file)
    memo = {w: [r] for p, r in ranks.items() if (w := _as_text(p)) is not None}
    table = pa.ipc.open_stream(folded).read_all()
    memo.update(zip(table["w"].to_pylist(), table["ids"].to_pylist()))
    return memo, ranks


def _arrow_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def known_runs(words: list[str], memo: dict[str, list[int]], ranks: dict[bytes, int]
               ) -> tuple[list[list[int]], list[int], list[str]]:
    """Ids between the words to fold, the number of the word after each but the last of these
    runs, and those distinct words."""
    found = list(map(memo.get, words))
    runs, order, rare, at = [], [], {}, 0
    for i in [i for i, ids in enumerate(found) if ids is None]:
        data = words[i].encode()
        if len(data) > HEAP_FROM:
            found[i] = merge_word(data, ranks)
            continue
        runs.append(list(chain.from_iterable(found[at:i])))
        order.append(rare.setdefault(words[i], len(rare)))
        at = i + 1
    runs.append(list(chain.from_iterable(found[at:] if at else found)))
    return runs, order, list(rare)


def _lists(parts: list[list], values: pa.Array) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _integers(parts: list[list[int]]) -> pa.Array:
    n = sum(map(len, parts))
    return pa.array(np.fromiter(chain.from_iterable(parts), np.int32, n))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids",
           n_head: int = HEAD_WORDS) -> DataFrame:
    """The documents with ``out``: the ids of the whole text, as the tiktoken library gives.

    NULL and empty texts have no ids; repeated rows, NULL keys and all other columns are
    kept (a column named like ``out`` is replaced).  Special strings are ordinary text.
    """
    spark, ranks = docs.sparkSession, read_ranks(path)
    n_ranks, literals = len(ranks), stored_literals(spark, ranks)
    # at most n_head words of at most HEAD_BYTES
    head = head_words(docs, literals, n_ranks, text, n_head).toArrow()
    sent = spark.sparkContext.broadcast((_arrow_bytes(head), Path(path).read_bytes()))
    source = PATTERN.replace(_SPACE, r"\s")
    kept = [f for f in docs.schema.fields if f.name != out]
    read, runs, order, rare = (unused(f"_{c}", docs) for c in ("read", "runs", "order", "rare"))
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept, T.StructField(runs, T.ArrayType(whole)),
                           T.StructField(order, whole),
                           T.StructField(rare, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, by_bytes = _memo(*sent.value)
        split = _pattern(source).findall
        for batch in batches:
            for part in slices(batch, read):
                found = [known_runs(split(value or ""), memo, by_bytes)
                         for value in part[read].to_pylist()]
                between, after, words = ([f[k] for f in found] for k in range(3))
                flat = list(chain.from_iterable(between))
                columns = {f.name: part[f.name] for f in kept}
                columns[runs] = _lists(between, _lists(flat, _integers(flat)))
                columns[order] = _lists(after, _integers(after))
                columns[rare] = _lists(words, pa.array(chain.from_iterable(words), pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    split = docs.select(*[F.col(f"`{f.name}`") for f in kept],
                        F.col(text).alias(read)).mapInArrow(run, schema)

    def ids(held: Column) -> Column:
        folded = F.transform(F.col(rare), lambda w: fold_merges(as_bytes(w), held["ranks"], n_ranks))
        joined = let(folded, lambda words: F.flatten(F.zip_with(
            F.col(runs), F.col(order), lambda ahead, i: F.when(i.isNull(), ahead).otherwise(
                F.concat(ahead, F.get(words, i))))))
        return F.when(F.size(rare) == 0, F.get(F.col(runs), F.lit(0))).otherwise(joined)

    return with_scalar(split, literals.select("ranks"), out, ids).drop(runs, order, rare)


def _as_text(piece: bytes) -> str | None:
    """A piece as a word; NULL for bytes that are no text by themselves."""
    try:
        return piece.decode()
    except UnicodeDecodeError:
        return None


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with ``out``: the bytes of their ids; an unknown id gives NULL."""
    ranks = read_ranks(path)
    listed, top = F.col(ids), max(ranks.values(), default=-1)
    known = (F.size(listed) == 0) | ((F.array_min(listed) >= 0) & (F.array_max(listed) <= top) & (
        F.size(F.array_compact(listed)) == F.size(listed)))

    def text(held: Column) -> Column:
        pieces = F.transform(listed, lambda i: F.get(held["pieces"], i))
        return F.when(known, F.encode(F.array_join(pieces, ""), "ISO-8859-1"))

    return with_scalar(df, stored_literals(df.sparkSession, ranks).select("pieces"), out, text)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, number of ids, and digests of the ids (decimal, with commas) and decoded bytes."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(key, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
