"""Exact removal of repeated byte strings through merged Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.bloom import filter_bits, has, twice_filter
from xtalframe.llm.common import text_key, texts, written
from xtalframe.llm.textbytes import mix, parts, prefix_hashes

NAMES = ("row", "anchor", "start", "extra", "offset")
GRAM = 32
ANCHORS_A_ROW = 128
BATCH_SYMBOLS = 60_000  # strings merged together; one group, of HOT strings at most, may be larger
HOT = 8192  # pieces of one key that may meet in a task
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments that cover every ``length``-byte window of every row.

    The anchor of a window is its ``GRAM``-byte string of least hash (the
    leftmost of equals), so equal windows have equal anchors at equal places.
    Windows in a row that share an anchor form a segment: row, start, extra
    (its windows start at start .. start + extra), the anchor's offset from start
    and the anchor's hash. The hash chooses what is compared; it decides nothing.
    """
    n, w = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return {k: none.astype(np.uint64) if k == "anchor" else none for k in NAMES}
    sums, down = prefix_hashes(data)
    value = (sums[GRAM:] - sums[: n + 1 - GRAM]) * down[: n + 1 - GRAM]
    bits = np.uint64(int(n).bit_length())
    low = mix(value) >> bits << bits
    low |= np.arange(len(low), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (w - span)], low[w - span :]) if w > span else low
    place = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # a window starts where it ends before its row does
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(place)] - np.arange(len(place)) >= length
    first = room.copy()
    first[1:] &= ~room[:-1] | (place[1:] != place[:-1])
    last = room.copy()
    last[:-1] &= ~room[1:] | (place[1:] != place[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    extra, at = end - start, place[start]
    row = np.searchsorted(offsets, start, "right") - 1
    return {
        "row": row,
        "start": start - offsets[row],
        "extra": extra,
        "offset": at - start,
        "anchor": mix(value[at]),
    }


def block_codes(symbols: np.ndarray, ahead, width: int) -> np.ndarray:
    """Dense code of the ``width`` symbols from every place on, round its string:
    codes of two halves are paired and made dense again, so no two blocks fall
    together."""
    known: dict[int, np.ndarray] = {}

    def code(w: int) -> np.ndarray:
        if w not in known:
            if w == 1:
                pairs = symbols
            else:
                left, right = code(w // 2), code(w - w // 2)
                pairs = left * (int(right.max(initial=0)) + 1) + right[ahead(w // 2)]
            known[w] = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        return known[w]

    out = code(width)
    return out.astype(np.uint16 if out.max(initial=0) < 1 << 16 else np.uint32)


def repeated_intervals(strings: list[np.ndarray], depth: int, shards: int = 4, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Places of the joined strings in suffix order, and the number of the
    interval each lies in: one interval for all suffixes that share ``depth``
    symbols.

    Strings are dealt to shards, and each shard's Burrows-Wheeler transform is
    built alone; its symbols are blocks of ``width`` symbols, so that one round
    prepends a block. The merge knows only the interleave, that is which shard
    each place of the merged order comes from. A round deals the interleave by
    the transforms' next symbols, stably; after it, suffixes are in order of one
    block more, and a border stands wherever a symbol or an earlier interval
    differs. No suffix is compared or sorted again.
    """
    width = max(w for w in range(1, most + 1) if depth % w == 0)
    size = np.array([len(s) + 1 for s in strings])
    base = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(strings)), size)
    start, length = base[row], size[row]
    place = np.arange(base[-1]) - start
    symbols = np.zeros(base[-1], np.int64)
    symbols[place < length - 1] = np.concatenate(strings) + 1 if strings else 0

    def ahead(k: int) -> np.ndarray:
        return start + (place + k) % length

    codes = block_codes(symbols, ahead, width)
    orders, shard_of = [], row % shards
    for s in range(shards):
        order = np.flatnonzero(shard_of == s)
        for k in range(depth - width, -1, -width):
            key = codes[ahead(k)]
            order = order[np.argsort(key[order], kind="stable")]
        orders.append(order)
    suffixes = np.concatenate(orders)
    transforms = codes[ahead(-width)[suffixes]]
    source = np.repeat(np.arange(shards, dtype=np.uint8), [len(o) for o in orders])
    interval = np.zeros(len(source), np.int64)
    for _ in range(depth // width):
        symbol = np.empty_like(transforms)
        symbol[np.argsort(source, kind="stable")] = transforms  # each shard's symbols in turn
        order = np.argsort(symbol, kind="stable")
        source, symbol, before = source[order], symbol[order], interval[order]
        border = np.ones(len(order), np.int64)
        border[1:] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        interval = np.cumsum(border) - 1
    merged = np.empty(len(source), np.int64)
    merged[np.argsort(source, kind="stable")] = suffixes
    return merged, interval


# A segment's place in one number: start, extra windows, the anchor's offset and
# whether it is the first of its content in the row. Extra and offset are below
# ``length``, which takes seven bits.
def pack(start, extra, offset, lead) -> np.ndarray:
    return (start << 15) | (extra << 8) | (offset << 1) | lead.astype(np.int64)


def content(data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each segment's bytes and its shape."""
    view = memoryview(data)
    at = offsets[found["row"]] + found["start"]
    digest = xxhash.xxh3_128_digest
    cuts = zip(at.tolist(), (at + found["extra"] + length).tolist(), (found["extra"] << 7 | found["offset"]).tolist())
    both = np.frombuffer(b"".join([digest(view[a:b], shape) for a, b, shape in cuts]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def occurrences(read: DataFrame, bitmap: np.ndarray, bits: int, length: int) -> DataFrame:
    """anchor, segment, check, doc, mark, place of the segments whose anchor the
    filter has; segment and check together stand for the content."""
    shared = read.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in parts(batch, 2):
                found = anchors(data, offsets, length)
                take = has(shared.value, found["anchor"], bits)
                found = {k: v[take] for k, v in found.items()}
                row, anchor, start, extra, offset = (found[k] for k in NAMES)
                segment, check = content(data, offsets, found, length)
                order = np.lexsort((start, check, segment, row))
                lead = np.ones(len(row), bool)
                same = (row[order][1:] == row[order][:-1]) & (segment[order][1:] == segment[order][:-1]) & (check[order][1:] == check[order][:-1])
                lead[order[1:][same]] = False
                doc, mark = (part.column(c).to_numpy()[row] for c in (0, 1))
                columns = (anchor.view(np.int64), segment, check, doc, mark, pack(start, extra, offset, lead))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    schema = "anchor long, segment long, check long, doc long, mark long, place long"
    names = [f.split()[0] for f in schema.split(", ")]
    return read.mapInArrow(run, schema)


def packed(read: DataFrame) -> DataFrame:
    """The rows with their bytes compressed, as they travel to a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = pa.array([pack(t.as_py()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3)], names=["doc", "mark", "data", "doc_id"])

    return read.mapInArrow(run, "doc long, mark long, data binary, doc_id long")


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pieces(read: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, check, doc, mark, start, windows, at, string: of every wanted segment
    the windows with more context after the anchor, and those with more before it.

    All windows of a piece hold the anchor and half of the other bytes on one
    side; that stretch, told by the 128 bits of key and check, stands in the
    string as one symbol.
    """
    half = (length - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "check", "doc", "mark", "start", "windows", "at", "string"]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            out = []
            for doc, mark, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpacked(text)
                for place in places:
                    start, extra, offset = place >> 15, place >> 8 & 127, place >> 1 & 127
                    text_of = text[start : start + extra + length]
                    split = max(0, offset - half)  # windows before it have more bytes before the anchor
                    for first, end, key_at in ((0, split, offset - half), (split, extra + 1, offset)):
                        if first >= end or first > extra:
                            continue
                        end = min(end, extra + 1)
                        part = text_of[first : end - 1 + length]
                        at = key_at - first
                        key = part[at : at + GRAM + half]
                        digest = xxhash.xxh3_128_intdigest(key, seed=key_at == offset)
                        out.append(
                            (
                                (digest >> 64) - (1 << 63),
                                (digest & (1 << 64) - 1) - (1 << 63),
                                doc,
                                mark,
                                start + first,
                                end - first,
                                at,
                                part[:at] + part[at + GRAM + half :],
                            )
                        )
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    asked = wanted.groupBy("doc", "mark").agg(F.collect_list("place").alias("places"))
    joined = packed(read).join(asked, ["doc", "mark"]).select("doc", "mark", "data", "places")
    return joined.mapInArrow(
        run, "key long, check long, doc long, mark long, start long, windows long, at long, string binary"
    )


def hot_windows(found: DataFrame, length: int, hot: int) -> DataFrame:
    """As ``repeated_windows``, for keys of any number of pieces.

    A window without its key is ``rest`` bytes and the key's place among them.
    Each becomes a row, and the least (doc, start) of equal ones is an
    aggregate, so no task holds a key. Windows that more than ``hot`` rows share
    are few, and joined by broadcast; a join by key would gather their rows.
    """
    rest = length - GRAM - (length - GRAM) // 2
    same = ["key", "check", "side", "content"]
    windows = found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1))).select(
        "key",
        "check",
        (F.col("at") - F.col("k")).alias("side"),
        F.substr("string", (F.col("k") + 1).cast("int"), F.lit(rest)).alias("content"),
        "doc",
        "mark",
        (F.col("start") + F.col("k")).alias("start"),
    )
    firsts = windows.groupBy(*same).agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1"), "window-firsts")
    common = F.broadcast(firsts.where(F.col("n") > hot).drop("n"))
    others = windows.join(common.drop("first"), same, "left_anti").join(firsts.where(F.col("n") <= hot).drop("n"), same)
    # rows of one document at one place are the same occurrence
    later = windows.join(common, same).unionByName(others).where("doc <> first.doc or start <> first.start")
    return later.select("doc", "mark", "start", (F.col("start") + length).alias("end"))


def repeated_windows(found: DataFrame, length: int) -> DataFrame:
    """doc, mark, start, end of the pieces' windows that also start earlier.

    Pieces of one key meet in one task; keys come one after the other, and what
    is held is one batch of them. A key holds different contents only: equal
    segments were made one before, however many documents hold them. At the edge
    of a passage that many documents share, each has contents of its own: keys
    of more than ``HOT`` pieces are settled window by window, over all tasks.
    """
    half = (length - GRAM) // 2
    depth = length - GRAM - half + 1
    keys = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "piece-keys")
    hot = F.broadcast(keys.where(F.col("n") > HOT).select("key"))
    crowded = not hot.isEmpty()
    cool = found.join(hot, "key", "left_anti") if crowded else found
    rows = cool.join(keys.where(F.col("n") <= HOT).select("key"), "key").repartition("key").sortWithinPartitions("key")

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, check, doc, mark, start, windows, at = (
            t.column(c).to_numpy() for c in ("key", "check", "doc", "mark", "start", "windows", "at")
        )
        number = np.unique(np.stack([key, check], 1), axis=0, return_inverse=True)[1].reshape(-1)
        strings = []
        for k, s in enumerate(t.column("string").to_pylist()):
            b, a = np.frombuffer(s, np.uint8).astype(np.int64), int(at[k])
            strings.append(np.concatenate([b[:a], [256 + number[k]], b[a:]]))
        places, interval = repeated_intervals(strings, depth)
        size = np.array([len(s) + 1 for s in strings])
        base = np.concatenate([[0], np.cumsum(size)])
        row = np.searchsorted(base, places, "right") - 1
        inside = places - base[row]
        ok = inside < windows[row]
        row, inside, interval = row[ok], inside[ok], interval[ok]
        where = start[row] + inside
        order = np.lexsort((where, doc[row], interval))
        row, inside, interval, where = row[order], inside[order], interval[order], where[order]
        later = np.zeros(len(order), bool)
        later[1:] = interval[1:] == interval[:-1]
        # rows of one document at one place are the same occurrence
        firsts = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
        later &= (doc[row] != doc[row[firsts]]) | (where != where[firsts])
        row, where = row[later], where[later]
        order = np.lexsort((where, row))
        row, where = row[order], where[order]
        new, last = np.ones(len(row), bool), np.ones(len(row), bool)
        if len(row):
            new[1:] = (row[1:] != row[:-1]) | (where[1:] != where[:-1] + 1)
            last[:-1] = new[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[row[new]], mark[row[new]], where[new], where[last] + length)],
            names=["doc", "mark", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                t = pa.Table.from_batches([batch.slice(at, 1000)])
                rest = t if rest is None else pa.concat_tables([rest, t])
                key = rest.column("key").to_numpy()
                if rest.num_rows * (length + 2 - GRAM) < 2 * BATCH_SYMBOLS or key[0] == key[-1]:
                    continue
                cut = int(np.searchsorted(key, key[-1]))
                yield from resolve(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from resolve(rest)

    settled = rows.mapInArrow(run, "doc long, mark long, start long, end long")
    return settled.unionByName(hot_windows(found.join(hot, "key"), length, HOT)) if crowded else settled


def repeats(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """The read rows, and doc, mark, spans: stretches of each text covered by
    ``length``-byte strings that also start earlier.

    1. Every window lies in a segment around its anchor. Segments whose anchor
       a Bloom pair has seen twice are looked at; the filter's size follows the
       number of rows up to a bound, and only what is looked at depends on it.
    2. Equal segments fall together by 128 bits of their bytes: all but the
       earliest are repeats as a whole, whatever number of documents holds them.
    3. Earliest segments that share an anchor with a different one are cut into
       pieces by more context, and the Burrows-Wheeler transforms of the pieces
       that still share it are merged; intervals of ``length`` bytes give the
       windows that another segment holds earlier. Where very many pieces share
       it, their windows are aggregated instead.
    """
    read = texts(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        text_key().alias("mark"),
        F.col("text").cast("binary").alias("data"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets in parts(batch, 2):
            yield anchors(data, offsets, length)["anchor"]

    bits = filter_bits(docs.count() * ANCHORS_A_ROW)
    found = written(occurrences(read, twice_filter(read, bits, hashes), bits, length), "segments")
    whole_of = ["segment", "check"]
    contents = written(
        found.groupBy("anchor", *whole_of).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")), "contents"
    )
    mixed = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", F.lit(True).alias("mixed"))
    looked = contents.join(mixed, "anchor", "left").where("n > 1 or mixed")
    start, extra = F.shiftright("place", 15), F.shiftright("place", 8).bitwiseAND(F.lit(127))
    lead = F.col("place").bitwiseAND(F.lit(1)) == 1
    each = found.join(looked.select(*whole_of, "first", "mixed"), whole_of).select(
        "doc", "mark", "place", (lead & (F.col("doc") == F.col("first"))).alias("earliest"), "mixed"
    )
    each = written(each.where("not earliest or mixed"), "segment-verdicts")
    whole = each.where("not earliest").select("doc", "mark", start.alias("start"), (start + extra + length).alias("end"))
    wanted = each.where("earliest and mixed").select("doc", "mark", "place").distinct()
    cut = written(pieces(read, wanted, length), "segment-pieces")
    spans = whole.unionByName(repeated_windows(cut, length))
    return read, spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left)
    of every row.

    A byte goes if a ``length``-byte string over it also starts earlier: in a
    smaller doc_id, or further to the front of the same document. Null and
    short texts lose nothing. Rows that repeat a doc_id count as the same
    document at the same places, so equal rows keep what one alone would; texts
    under one doc_id are told apart by a 64-bit hash. Rows without doc_id come
    last. Very long texts take some ninety bytes of a worker for each byte.
    Columns besides doc_id and text are not looked at. An empty table has no rows.
    """
    read, spans = repeats(docs, length)
    named = packed(read).join(spans, ["doc", "mark"], "left").select("doc_id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                text = unpacked(text.as_py())
                kept, at, n_spans, removed = [], 0, 0, 0
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                for a, b in merged:
                    kept.append(text[at:a])
                    removed, n_spans, at = removed + b - a, n_spans + 1, b
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return named.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
