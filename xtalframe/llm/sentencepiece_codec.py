"""Exact BPE encoding by each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from xtalframe.llm.common import texts
from xtalframe.llm.vocabulary import SPACE, Recent, Vocabulary, default_model, load, marked, words_of

CACHE = 400_000
PAIRS = 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


class Encoder:
    """Encodes words with the prefix table.

    For every prefix of a word exactly one token can end its encoding: the one
    that stands well beside the last token of the prefix before it. Tokens that
    end at a place come from the automaton. Two tokens stand well beside each
    other if the encoding of their joined text is just the two; that is found
    once per pair and remembered. The ids are then read backwards through the
    table.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: list[dict[int, bool]] = [{} for _ in vocabulary.pieces]  # by the left one
        self.n_pairs = 0
        self.whole: dict[int, bool] = {}
        self.traces: dict[int, list[tuple[float, str, str]]] = {}
        byte_of = {i: bytes((b,)) for b, i in enumerate(vocabulary.bytes)}
        self.raws = [byte_of.get(i, p.encode()) for i, p in enumerate(vocabulary.pieces)]
        self.sizes = [len(p) for p in vocabulary.pieces]
        self.names = [str(i) for i in range(len(vocabulary.pieces))]
        self.words = Recent(CACHE, self.word)

    def merged(self, symbols: list[str], steps: list | None = None) -> list[str]:
        """Merge the best adjacent pair, leftmost first, until none is a piece."""
        ids, scores = self.v.ids, self.v.scores
        n = len(symbols)
        end = n - 1
        text, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if 0 <= a and after[a] < n:
                joined = text[a] + text[after[a]]
                if joined in ids:
                    heapq.heappush(heap, (-scores[ids[joined]], a, joined))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, joined = heapq.heappop(heap)
            if not text[a] or after[a] >= n or text[a] + text[after[a]] != joined:
                continue
            gone = after[a]
            text[a], text[gone], after[a] = joined, "", after[gone]
            if gone == end:
                end = a
            if steps is not None:
                steps.append((scores[ids[joined]], text[0], text[end]))
            if after[a] < n:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [t for t in text if t]

    def stands(self, i: int) -> bool:
        """Whether the piece is the encoding of its own text."""
        known = self.whole.get(i)
        if known is None:
            known = self.whole[i] = self.merged(list(self.v.pieces[i])) == [self.v.pieces[i]]
        return known

    def trace(self, i: int) -> list[tuple[float, str, str]]:
        """The merges that build a piece, in order: score, and the first and the
        last symbol after each."""
        known = self.traces.get(i)
        if known is None:
            known = self.traces[i] = []
            self.merged(list(self.v.pieces[i]), known)
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether both stand, and stand well beside each other: replay the
        merges of both in the order of their joined text; no merge across the
        border may come first."""
        if self.n_pairs >= PAIRS:
            for known_pairs in self.pairs:
                known_pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs[a][b] = self.stands(a) and self.stands(b) and self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        left, right, ids, scores = self.trace(a), self.trace(b), self.v.ids, self.v.scores
        x, y, i, j, none = self.v.pieces[a][-1], self.v.pieces[b][0], 0, 0, float("-inf")
        while True:
            joined = ids.get(x + y)
            across = none if joined is None else scores[joined]
            p = left[i][0] if i < len(left) else none
            q = right[j][0] if j < len(right) else none
            if across > p and across >= q:  # at equal scores the merge further left goes first
                return False
            if p == q == none:
                return True
            if p >= q:
                x = left[i][2]
                i += 1
            else:
                y = right[j][1]
                j += 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word. A character outside the vocabulary stands alone as
        its bytes: no piece holds it, so nothing merges across it."""
        if self.v.characters.issuperset(word):
            return self.encode_known(word)
        out: list[int] = []
        start = 0
        for at, c in enumerate(word):
            if c not in self.v.characters:
                out += self.encode_known(word[start:at])
                out += [self.v.bytes[b] for b in c.encode()]
                start = at + 1
        return out + self.encode_known(word[start:])

    def encode_known(self, word: str) -> list[int]:
        """Ids of a word whose characters all are pieces."""
        n = len(word)
        last, pairs, whole = [-1] * (n + 1), self.pairs, self.whole
        for end, (i, k) in self.v.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if k == end:
                fits = whole.get(i)
                if fits is None:
                    fits = self.stands(i)
            else:
                before = last[end - k]
                fits = pairs[before].get(i)
                if fits is None:
                    fits = self.beside(before, i)
            if fits:
                last[end] = i
        out: list[int] = []
        sizes, at = self.sizes, n
        while at:
            i = last[at]
            out.append(i)
            at -= sizes[i]
        out.reverse()
        return out

    def raw(self, ids: list[int]) -> bytes:
        """Bytes of the pieces, markers and all."""
        raws = self.raws
        return b"".join([raws[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join into characters, markers become
        spaces, and the marker that encoding put first goes."""
        return text_of(self.raw(ids))

    def word(self, word: str) -> tuple[str, bytes]:
        """Ids of a word of ``words_of``, joined, and their bytes."""
        ids, names = self.encode_word(marked(word)), self.names
        return ",".join([names[i] for i in ids]), self.raw(ids)

    def encoded(self, text: str) -> tuple[str, bytes]:
        """The same of a whole text."""
        if not text:
            return "", b""
        ids, raws = zip(*map(self.words.__getitem__, words_of(text)))
        return ",".join(ids), b"".join(raws)

    def encode(self, text: str) -> list[int]:
        joined, _ = self.encoded(text)
        return list(map(int, joined.split(","))) if joined else []


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """One encoder for each Python worker: what a task has learned of words and
    pairs serves the tasks after it."""
    return Encoder(load(path))


def text_of(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _map(docs: DataFrame, schema: str, row: Callable, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encoder = kept_encoder(path)
        fields = [f.split() for f in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # a bounded number of results at a time
                part = batch.slice(start, 256)
                columns = list(zip(*[row(encoder, t.as_py()) for t in part.column(1)]))
                arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *arrays], names=[f[0] for f in fields]
                )

    return texts(docs).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every whole text, without begin or end ids.

    One row per input row, no shuffle. Words repeat, so each worker remembers
    up to ``CACHE`` of them. Null
    and empty texts have no ids and decode to the empty string; very long
    texts take memory in proportion to the longest word and to the row.
    """

    def row(encoder: Encoder, text: str) -> tuple:
        ids = encoder.encode(text)
        decoded = encoder.decode(ids)
        return len(ids), _sha(",".join(map(str, ids)).encode()), _sha(decoded.encode()), ids, decoded

    return _map(docs, SCHEMA, row, path or default_model())


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same without the ids and texts themselves: counts and digests."""

    def row(encoder: Encoder, text: str) -> tuple:
        ids, raw = encoder.encoded(text)
        return ids.count(",") + 1 if ids else 0, _sha(ids.encode()), _sha(text_of(raw).encode())

    return _map(docs, ", ".join(SCHEMA.split(", ")[:4]), row, path or default_model())
