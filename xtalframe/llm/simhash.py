"""Near-duplicate documents by SimHash fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import Aside, text_key, texts, written
from xtalframe.llm.components import components

SEED = 42
CHUNK = 1 << 15  # shingles whose bits are counted at once
#: Blocks at each level of splitting. Groups of a level's keys that are too
#: large go to the next; at the last a key leaves 4 bits open for each different
#: bit allowed, so its group holds at most 2**8 fingerprints for two of them.
LEVELS = (6, 16)
GROUP = 32
FINGERPRINTS = "doc_id long, text_key long, fp long"


def fingerprint(data: bytes, k: int) -> int:
    """64 bits, each set if more than half the shingles' hashes have it."""
    words = data.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    view = memoryview(line)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(line))
    starts, ends = (starts[: 1 - k or None], ends[k - 1 :]) if len(words) >= k else (starts[:1], ends[-1:])
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        cuts = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        h = np.array([digest(view[a:b], SEED) for a, b in cuts], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key and fp, a signed 64-bit number, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fps.view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    read = texts(docs).select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("data"))
    return read.mapInArrow(run, FINGERPRINTS)


def masks(blocks: int, bits: int) -> list[int]:
    """A mask for each choice of all blocks but ``bits``, as signed numbers: two
    fingerprints with at most so many different bits are equal under one."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    block = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    kept = (sum(block) - sum(gone) for gone in combinations(block, bits))
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def close_pairs(fps: DataFrame, bits: int = 2, levels: tuple[int, ...] = LEVELS, group: int = GROUP) -> DataFrame:
    """low, high: pairs of distinct fingerprints (column fp) with at most
    ``bits`` different bits; every pair at least once.

    Fingerprints join on their masked values and the distance is verified in
    the join. A key that more than ``group`` fingerprints share would make pairs
    by the square of its size: its fingerprints go on to the next level instead,
    where they are split into more and narrower blocks. Keys of the last level
    leave so few bits open that their groups are small by themselves, so a
    cluster of any size costs a bounded number of rows for each member.
    """
    found = None
    for number, blocks in enumerate(levels):
        last = number == len(levels) - 1
        table = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(blocks, bits))])
        keyed = fps.select("fp", F.explode(table).alias("m")).select("m.mask", "m.key", "fp")
        size = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = written(keyed.join(size, ["mask", "key"]), "shared-blocks")
        few = shared if last else shared.where(F.col("n") <= group)
        other = few.select("mask", "key", F.col("fp").alias("high"))
        near = (F.col("fp") < F.col("high")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("high"))) <= bits)
        pairs = few.join(other, ["mask", "key"]).where(near).select(F.col("fp").alias("low"), "high")
        found = pairs if found is None else found.unionByName(pairs)
        if not last:
            fps = shared.where(F.col("n") > group).select("fp").distinct()
    return found


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 3) -> DataFrame:
    """doc_id, text_key, fp, fingerprint (16 hex digits) and component_id of
    every row.

    A fingerprint is made of the hashes of all shingles of ``words`` words,
    repeats included; a text of fewer words is one shingle. Rows are linked when
    their fingerprints differ in at most ``bits`` bits; component_id is the
    smallest doc_id that links reach. Rows with one fingerprint are one node
    from the start, so copies cost nothing more, however many there are.

    Null and empty texts and texts without words have fingerprint zero and are
    linked like any other. A very long text takes memory in proportion to
    itself (some twenty bytes a byte for its words), its bits are counted in
    chunks. Exactly half the shingles is no majority: the bit stays 0. Repeated
    rows fall together; a row without doc_id never names a component that has
    another row, else component_id is null. Columns besides doc_id and text are
    not looked at. An empty table has no rows.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(close_pairs(nodes.select("fp"), bits))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp", "left").select(
        "doc_id", "text_key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, words: int = 5, bits: int = 3) -> DataFrame:
    """The rows of the smallest doc_id in each component, all columns kept.
    Rows without doc_id stay where their component has none."""
    found = near_duplicates(docs, words, bits)
    return Aside(docs).without(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key"))
