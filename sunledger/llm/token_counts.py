"""Exact token counts of every prefix of a text, by dynamic programming.

For a byte-pair encoding the last token of a prefix determines the rest: if ``t`` ends the
prefix of length i, then the tokens before it are exactly the encoding of the prefix of
length ``i - len(t)``.  So one pass over the positions, which looks for the one token that
may follow the last token of an earlier prefix, gives the number of tokens of all prefixes.
Truncation to a token budget and the cost of any prefix are then look-ups.

Texts are cut by the vocabulary's own pattern first and pieces are memoised per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sunledger.llm.common import slices

#: fixed values: the split of byte-level vocabularies of this family
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: pieces remembered in a worker; when full the memory is emptied
MEMO_PIECES = 400_000

_MODELS: dict[str, "PrefixModel"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in vocabulary files of this format."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class PrefixModel:
    """Prefix counts under one byte-level BPE vocabulary in the ``tokenizers`` format."""

    def __init__(self, path: str, memo: int = MEMO_PIECES) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = {c: b for b, c in _byte_letters().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        added = [a["content"] for a in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))
                                     ) if added else None
        self.split = regex.compile(PATTERN)
        self.memo_limit = memo
        self._tokens = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self._tokens.add_word(token.decode("latin-1"), (len(token), i))
        self._tokens.make_automaton()
        self._memo: dict[str, Sequence[int]] = {}
        self._follows: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain ranked merging, used to learn which tokens may be neighbours."""
        ids = [self.vocab[piece[i:i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:]))
                        if p in self.rank), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i:i + 2] = [new]
        return ids

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        if len(self._follows) > 4 * self.memo_limit:
            self._follows.clear()
        apart = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        self._follows[left << 32 | right] = apart
        return apart

    def _reachable(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def piece_counts(self, piece: bytes) -> Sequence[int]:
        """Tokens of every byte prefix of one piece, from length 0."""
        n, follows = len(piece), self._follows
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        # the automaton names the tokens that end at each byte, longest first
        for end, (length, token) in self._tokens.iter(piece.decode("latin-1")):
            i = end + 1
            if counts[i]:
                continue
            j = i - length
            if j:
                left = last[j]
                fits = follows.get(left << 32 | token)
                if fits is None:
                    fits = self._may_follow(left, token)
            else:
                fits = self._reachable(token)
            if fits:
                last[i], counts[i] = token, counts[j] + 1
        return bytes(counts) if n < 256 else np.array(counts, np.int32)

    def counts(self, piece: str) -> Sequence[int]:
        known = self._memo.get(piece)
        if known is None:
            if len(self._memo) >= self.memo_limit:
                self._memo.clear()
            known = self.piece_counts(piece.encode())
            if len(piece) <= 64:
                self._memo[piece] = known
        return known

    def plain_total(self, text: str) -> int:
        memo, total = self._memo, 0
        for piece in self.split.findall(text):
            known = memo.get(piece)
            total += (self.counts(piece) if known is None else known)[-1]
        return int(total)

    def total(self, text: str) -> int:
        """Tokens of a whole text; a special string is one token."""
        if self.special is None or not self.special.search(text):
            return self.plain_total(text)
        total = end = 0
        for m in self.special.finditer(text):
            total += self.plain_total(text[end:m.start()]) + 1
            end = m.end()
        return total + self.plain_total(text[end:])

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to its length, in code points.

        A prefix that ends inside a piece is cut by the pattern again from the start of the
        white space before that piece, since only the cut of that stretch can change.  A
        special string counts as such only when it is complete.
        """
        out = np.zeros(len(text) + 1, np.int64)
        before = end = 0
        stops = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        for start, stop in [*stops, (len(text), len(text))]:
            # the characters of a special string are ordinary text until it is complete
            self._fill(text[end:stop], out, end, before)
            if stop > start:
                before = int(out[start]) + 1
                out[stop] = before
            end = stop
        return out

    def _fill(self, text: str, out: np.ndarray, at: int, before: int) -> None:
        done, from_, total_from = before, 0, before
        previous_blank = False
        for m in self.split.finditer(text):
            piece = m.group()
            if not previous_blank:
                from_, total_from = m.start(), done
            if len(piece) > 1:
                inner = [1 + len(c.encode()) - 1 for c in piece]
                at_bytes = np.cumsum(inner)
                own = self.counts(piece)
            for k in range(1, len(piece)):
                head = text[from_:m.start() + k]
                cut = self.split.findall(head)
                if cut[-1] == piece[:k] and piece.encode()[:at_bytes[k - 1]] == cut[-1].encode():
                    rest = sum(int(self.counts(p)[-1]) for p in cut[:-1])
                    out[at + m.start() + k] = total_from + rest + own[at_bytes[k - 1]]
                else:
                    out[at + m.start() + k] = total_from + sum(
                        int(self.counts(p)[-1]) for p in cut)
            done += int(self.counts(piece)[-1])
            out[at + m.end()] = done if m.end() == len(text) or not piece.isspace() else \
                total_from + sum(int(self.counts(p)[-1])
                                 for p in self.split.findall(text[from_:m.end()]))
            previous_blank = piece.isspace()


def model(path: str) -> PrefixModel:
    """The model of a vocabulary file, loaded once in every worker process."""
    if path not in _MODELS:
        _MODELS[path] = PrefixModel(path)
    return _MODELS[path]


def _map(df: DataFrame, key: str, text: str, path: str, outputs: str, fn) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for piece in slices(batch, "_text", 8 << 20):
                columns = fn(own, piece["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays([piece[key], *columns.values()],
                                                 names=[key, *columns])
    return (df.select(df[key], df[text].alias("_text"))
            .mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {outputs}"))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    NULL counts as the empty text, which has no tokens; repeated rows and NULL keys are
    kept; other columns are left out.  The vocabulary file must exist on every machine.
    """
    def fn(own: PrefixModel, texts: list) -> dict:
        texts = [t or "" for t in texts]
        return {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array([own.total(t) for t in texts], pa.int64())}
    return _map(docs, key, text, path, "n_bytes long, n_tokens long", fn)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Key and ``counts``: tokens of the first i code points, for i from 0 to the length."""
    def fn(own: PrefixModel, texts: list) -> dict:
        return {"counts": pa.array([own.prefixes(t or "") for t in texts],
                                   pa.list_(pa.int64()))}
    return _map(docs, key, text, path, "counts array<long>", fn)


def truncate(docs: DataFrame, path: str, budget: int, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Key, ``kept`` (the longest prefix of at most ``budget`` tokens) and its ``n_tokens``."""
    def fn(own: PrefixModel, texts: list) -> dict:
        kept, tokens = [], []
        for t in texts:
            counts = own.prefixes(t or "")
            i = int(np.flatnonzero(counts <= budget)[-1])
            kept.append((t or "")[:i])
            tokens.append(int(counts[i]))
        return {"kept": pa.array(kept, pa.string()), "n_tokens": pa.array(tokens, pa.int64())}
    return _map(docs, key, text, path, "kept string, n_tokens long", fn)
