"""Cross-tokenizer alignment: which tokens of two vocabularies overlap."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import texts, written
from xtalframe.llm.vocabulary import LONG, SPACE, default_model

CACHE = 250_000
PIECE = 1 << 14  # steps of the merge in one piece
BATCH_CHARS = 1 << 20
#: Pairs that are broadcast at most, those of most documents first.
HEAVY = 1 << 20
#: Where both vocabularies begin anew: one space between two other characters.
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Texts without this can be split at every space.
UNEVEN = re.compile(r" \s|\s |^ | \Z")
#: Fixed value: how byte-level vocabularies split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_END = "\u0250"  # the letters before it are Latin in every version of Unicode
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others,
    in order, as the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers. Words repeat, and neither vocabulary has tokens across
    a ``BORDER``, so words are encoded one by one and remembered."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if letters.keys() >= set(token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        ordinary = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(SPACE in p.lstrip(SPACE) for p in ordinary):
            raise ValueError("a piece joins two words; texts can't be split at spaces")
        self.bytes_b = [
            bytes((int(_BYTE.fullmatch(p)[1], 16),)) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # a token, and what stands behind it: inside a group, at the end of its half
        names = [(str(i), "|") for i in range(len(self.bytes_a))] + [(str(i), ";") for i in range(len(self.bytes_b))]
        self.names = [n + end for n, last in names for end in (",", last)]
        self.words: dict[str, tuple[bytes, ...]] = {}
        self.older: dict[str, tuple[bytes, ...]] = {}
        self.latin = self.ranks()

    def ranks(self) -> object:
        """The same vocabulary A for texts of Latin letters, whose classes no two
        versions of Unicode tell apart: tokens merge in order of their ids."""
        import tiktoken

        known = {token: i for i, token in enumerate(self.bytes_a) if token}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    def cut(self, words: list[str], encode_a: Callable[[str], list[int]]) -> list[tuple[bytes, ...]] | None:
        """Packed ids of words, encoded as one text whose borders they are, and cut
        at their bytes; None if the tokens don't give the text back."""
        text = " " + " ".join(words)
        whole, ends = text.encode(), np.cumsum([len(w.encode()) + 1 for w in words])
        sides = ((encode_a(text), self.bytes_a, self.length_a), (self.b.encode(text[1:]), self.bytes_b, self.length_b))
        packed = []
        for ids, table, length in sides:
            if b"".join([table[i] for i in ids]) != whole:
                return None
            ids = np.array(ids, "<i4")
            token_ends = np.cumsum(length[ids])
            cuts = np.searchsorted(token_ends, ends, "right")
            if not cuts[0] or (token_ends[cuts - 1] != ends).any():
                return None
            data, cuts = ids.tobytes(), (4 * cuts).tolist()
            packed.append([data[a:b] for a, b in zip([0, *cuts], cuts)])
        return list(zip(*packed))

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, ...]]:
        """Ids of words with the space before them, packed; nothing where the
        tokens' bytes are not the word's. Words without white space at their
        ends go together, the others one by one."""
        groups: dict[str, list[str]] = {"latin": [], "other": [], "alone": []}
        for w in words:
            edge = w[0].isspace() or w[-1].isspace()
            groups["alone" if edge else "latin" if w.isascii() or max(w) < LATIN_END else "other"].append(w)
        of_a = {"latin": self.latin.encode_ordinary, "other": lambda t: self.a.encode(t, add_special_tokens=False).ids}
        out: dict[str, tuple[bytes, ...]] = {}
        for group, encode_a in of_a.items():
            found = self.cut(groups[group], encode_a) if groups[group] else []
            if found is None:
                groups["alone"] += groups[group]
            else:
                out |= zip(groups[group], found)
        rest = groups["alone"]
        if rest:
            a = self.a.encode_batch([" " + w for w in rest], add_special_tokens=False)
            for w, x, y in zip(rest, a, self.b.encode(rest, num_threads=1)):
                x, whole = x.ids, (" " + w).encode()
                same = b"".join([self.bytes_a[i] for i in x]) == whole == b"".join([self.bytes_b[i] for i in y])
                out[w] = (np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes()) if same else ()
        return out

    def hold(self, words: set[str]) -> dict[str, tuple[bytes, ...]]:
        """A table with all these words. When it has grown to half of ``CACHE``, it
        starts anew with them, and the old one is kept beside it for once."""
        missing = words.difference(self.words)
        if missing:
            found = {w: self.older[w] for w in missing.intersection(self.older)}
            found |= self.learn([w for w in missing if w not in found])
            if len(self.words) + len(found) > CACHE // 2:
                found |= {w: self.words[w] for w in words if w not in found}
                self.older, self.words = self.words, {}
            self.words |= found
        return self.words

    def encode(self, text: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of texts by both; none where a text has no tokens."""
        split = [[] if not t else BORDER.split(t) if UNEVEN.search(t) else t.split(" ") for t in text]
        words = set(chain.from_iterable(split))
        table = self.hold(words)
        lost = {w for w in words if not table[w]}
        a, b = [], []
        for ws in split:
            found = [table[w] for w in ws]
            if not found or (lost and not lost.isdisjoint(ws)):
                a.append(b"")
                b.append(b"")
                continue
            x, y = zip(*found)
            a.append(b"".join(x))
            b.append(b"".join(y))
        for w in [w for w in words if len(w) > LONG]:  # a giant word is not worth its memory
            table.pop(w, None)
        return a, b


@lru_cache(maxsize=1)
def kept_pair(path_a: str, path_b: str) -> Pair:
    """Once for each Python worker."""
    return Pair(path_a, path_b)


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many of the first d merged ends come from ``a``, for every d that
    is a multiple of ``step`` and for the last. At equal ends that of ``a`` goes
    first. All searches go on together."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        x = np.minimum(middle, len(a) - 1)
        y = np.clip(d - 1 - middle, 0, len(b) - 1)
        first = open_ & (a[x] <= b[y])
        low = np.where(first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low


class Overlaps(NamedTuple):
    a: np.ndarray  # tokens of each overlap
    b: np.ndarray
    cut_a: np.ndarray  # first tokens after each common end
    cut_b: np.ndarray


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Overlaps:
    """Overlaps and common ends that the merge steps from (i0, j0) to (i1, j1)
    meet. Every distinct end closes one stretch of bytes that one token of each
    side covers: an end of ``a`` with the token of ``b`` that ends there or
    later, an end of ``b`` alone likewise. An equal end of ``a`` may be the last
    step of the piece before."""
    ends_a, ends_b = a[i0:i1], b[j0:j1]
    of_a = j0 + np.searchsorted(ends_b, ends_a)
    after = i0 + np.searchsorted(ends_a, ends_b, "right")
    common = (after > 0) & (a[np.maximum(after - 1, 0)] == ends_b)
    alone = np.flatnonzero(~common)
    order = np.argsort(np.concatenate([ends_a, ends_b[alone]]), kind="stable")
    at_b = j0 + np.flatnonzero(common)
    return Overlaps(
        np.concatenate([np.arange(i0, i1), after[alone]])[order],
        np.concatenate([of_a, j0 + alone])[order],
        after[common],
        at_b + 1,
    )


def overlaps(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> Overlaps:
    """The whole merge, from its pieces; a group that goes on over a border of
    pieces is closed by the first common end after it."""
    i = diagonals(a, b, step)
    j = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b)) - i
    found = [piece_overlaps(a, b, *k) for k in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    if not found:
        return Overlaps(*[np.zeros(0, np.int64)] * 4)
    return Overlaps(*map(np.concatenate, zip(*found)))


def group_names(found: Overlaps, a: np.ndarray, b: np.ndarray, size_a: int) -> np.ndarray:
    """Tokens as they are written out, each group's of ``a`` and then its of
    ``b``: twice the id (those of ``b`` behind all of ``a``), and one for the
    last of its half."""
    start_a, start_b = (np.insert(cut, 0, 0)[:-1] for cut in (found.cut_a, found.cut_b))
    group_a = np.repeat(np.arange(len(start_a)), found.cut_a - start_a)
    group_b = np.repeat(np.arange(len(start_b)), found.cut_b - start_b)
    out = np.empty(len(a) + len(b), np.int64)
    last = np.zeros(len(a), np.int64)
    last[found.cut_a - 1] = 1
    out[np.arange(len(a)) + start_b[group_a]] = 2 * a + last
    last = np.zeros(len(b), np.int64)
    last[found.cut_b - 1] = 1
    out[np.arange(len(b)) + found.cut_a[group_b]] = 2 * (size_a + b) + last
    return out


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of parts of about ``BATCH_CHARS`` characters, one text at
    least."""
    start, some, size = 0, [], 0
    for k, t in enumerate(column):
        some.append(t.as_py())
        size += len(some[-1])
        if size >= BATCH_CHARS:
            yield start, some
            start, some, size = k + 1, [], 0
    if some:
        yield start, some


def alignments(docs: DataFrame, path_a: str, path_b: str, code: str, step: int = PIECE) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct
    linked pairs of ids (as one number, in order) with their occurrences."""
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{code}>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = kept_pair(path_a, path_b)
        size_a, size_b, names = len(both.bytes_a), len(both.bytes_b), both.names
        row = TaskContext.get().partitionId() << 40
        kind = pa.int32() if code == "int" else pa.int64()
        for batch in batches:
            for start, text in _batches(batch.column(1)):
                packed = both.encode(text)
                n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in packed)
                a, b = (np.frombuffer(b"".join(side), "<i4").astype(np.int64) for side in packed)
                found = overlaps(np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b]), step)
                ends_a, ends = np.cumsum(n_a), np.cumsum(n_a + n_b)
                # texts end at common ends, so no group or overlap lies in two
                of = np.searchsorted(ends_a, found.a, "right")
                written_out = group_names(found, a, b, size_a)
                digests = []
                for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    groups = "".join([names[k] for k in written_out[s:e].tolist()])[:-1]
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if e > s else "")
                span = size_a * size_b
                pairs, times = np.unique(of * span + a[found.a] * size_b + b[found.b], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(len(text) + 1) * span), pa.int32())
                columns = [
                    pa.array(row + np.arange(len(text))),
                    batch.column(0).slice(start, len(text)).cast(pa.int64()),
                    pa.array(n_a),
                    pa.array(n_b),
                    pa.array(np.bincount(np.searchsorted(ends_a, found.cut_a - 1, "right"), minlength=len(text))),
                    pa.array(np.bincount(of, minlength=len(text))),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs % span, kind)),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ]
                row += len(text)
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no other pair of its
    first id is in more). The best of each first id is at most one row for each
    of the vocabulary's ids, which bounds what is broadcast."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.floor(F.col("pair") / size_b).cast("long")
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), first == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def heavy_pairs(counts: DataFrame, most: int) -> pa.Table:
    """Pairs in the most documents: all with n of some power of two or more, the
    smallest power that leaves at most ``most``."""
    level = F.length(F.bin("n")) - 1
    by_level = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for r in by_level:  # 64 rows at most
        held += r["pairs"]
        if held > most:
            break
        least = 1 << r["level"]
    return counts.where(F.col("n") >= least if least else F.lit(False)).toArrow()


def with_counts(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` with n_best and count_sum. Heavy pairs are looked up where the
    rows are; the others, of few documents each, are joined."""
    heavy = heavy_pairs(counts, most)
    keys = heavy.column("pair").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    tables = (keys[order], heavy.column("n").to_numpy()[order], heavy.column("best").to_numpy()[order])
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{f} {t}" for f, t in rows.dtypes if f in plain) + ", n_best long, count_sum long, pairs array<long>, times array<int>"

    def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column("pairs")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                pairs = lists.flatten().to_numpy().astype(np.int64)
                times = part.column("times").flatten().to_numpy().astype(np.int64)
                offsets = offsets - offsets[0]
                place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
                value, is_best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                value[known], is_best[known] = n[place[known]], best[place[known]]
                rest = pa.array(np.concatenate([[0], np.cumsum(~known)])[offsets], pa.int32())
                columns = [part.column(c) for c in plain] + [
                    pa.array(summed(times * is_best, offsets)),
                    pa.array(summed(times * value, offsets)),
                    pa.ListArray.from_arrays(rest, pa.array(pairs[~known])),
                    pa.ListArray.from_arrays(rest, pa.array(times[~known], pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*plain, "n_best", "count_sum", "pairs", "times"])

    known = written(rows.mapInArrow(run, schema), "alignments-counted")
    light = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    rare = counts.select(F.col("pair").cast("long").alias("pair"), "n", "best")
    more = (
        light.join(rare, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return known.join(more, "row", "left").select(
        *plain[1:6], add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256"
    )


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, heavy: int = HEAVY, step: int = PIECE) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every row.

    A is a byte-level vocabulary over a space and the text, B a piece vocabulary
    over the text, which puts the space itself. The ends of both sides' tokens
    are merged; diagonal searches cut the merge into pieces of ``step`` steps,
    whatever the lengths of texts, and each piece gives its overlaps and common
    ends with memory of its own size only. Groups lie between common ends.

    n_best counts the links whose pair of ids is in as many documents as any
    other linked pair of its A id; count_sum adds up those documents. Rows that
    repeat a doc_id or a text are documents of their own. Pairs in the most
    documents, at most ``heavy``, are broadcast; the others are joined.

    Null and empty texts, and texts that the tokens' bytes don't give back (a
    text with U+2581), have no tokens: zeros, and an empty digest. Special
    tokens' strings are plain text. A very long text takes memory in proportion
    to itself, some hundred bytes for each of its tokens. Columns besides doc_id
    and text are not looked at. An empty table has no rows.
    """
    path_a, path_b = path_a or byte_model(), path_b or default_model()
    both = kept_pair(path_a, path_b)
    size_a, size_b = len(both.bytes_a), len(both.bytes_b)
    code = "int" if size_a * size_b < 1 << 31 else "long"
    rows = written(alignments(texts(docs), path_a, path_b, code, step), "alignments")
    counts = written(pair_counts(rows, size_b), "pair-best")
    return with_counts(rows, counts, heavy)
