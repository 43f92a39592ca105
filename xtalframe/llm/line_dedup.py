"""Lines repeated across documents: two Bloom filters, then exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.bloom import filter_bits, has, twice_filter
from xtalframe.llm.common import Aside, text_key, texts, written
from xtalframe.operators.skew import left_join

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
LINES_A_ROW = 64
HOLDERS_A_TASK = 2000
SUSPECTS = "doc_id long, text_key long, key binary, lines array<int>"


def line_keys(data: bytes, least: int) -> dict[bytes, list[int]]:
    """Key -> its lines' numbers, for keys of ``least`` code points or more."""
    found: dict[bytes, list[int]] = {}
    for n, line in enumerate(data.split(b"\n")):
        if len(line) < least:
            continue
        key = line.strip(SPACE).lower()
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            found.setdefault(key, []).append(n)
    return found


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5, bits: int | None = None) -> DataFrame:
    """doc_id, text_key, drop: the line numbers that each row loses.

    Filters only choose what is looked at exactly: a key that the twice filter
    has not is held by one row alone. Its size follows the number of rows up to
    2**28 bits (32 MB, broadcast); beyond that more keys are suspected and
    shuffled, and results stay the same. Suspected keys travel as 128-bit
    digests, one row for each key and document.
    """
    read = texts(docs).select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("data"))
    bits = bits or filter_bits(docs.count() * LINES_A_ROW)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.array([_hash(k) for t in batch.column(0) for k in line_keys(t.as_py(), least)], np.uint64)

    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(read.select("data"), bits, hashes))
    names = [f.split()[0] for f in SUSPECTS.split(", ")]

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            rows, hashes = [], []
            for n, t in enumerate(batch.column(2)):
                for key, lines in line_keys(t.as_py(), least).items():
                    rows.append((n, key, lines))
                    hashes.append(_hash(key))
            if not rows:
                continue
            yes = np.flatnonzero(has(bitmap, np.array(hashes, np.uint64), bits))
            taken = [rows[k] for k in yes]
            at = pa.array([n for n, _, _ in taken], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at).cast(pa.int64()),
                    batch.column(1).take(at),
                    pa.array([xxhash.xxh3_128_digest(k) for _, k, _ in taken], pa.binary()),
                    pa.array([x for _, _, x in taken], pa.list_(pa.int32())),
                ],
                names=names,
            )

    suspects = written(read.mapInArrow(suspect, SUSPECTS), "suspected-lines")
    held = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))  # a document once, however many rows it has
    repeated = (
        held.groupBy("key")
        .agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= documents)
        .select("key", "keeper")
    )
    # a line that very many documents hold is spread over tasks
    return (
        left_join(suspects, repeated, ["key"], "inner", share=HOLDERS_A_TASK)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("doc_id", "text_key", F.explode("lines").alias("line"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line").alias("drop"))
    )


def lines_left(docs: DataFrame, least: int = 40, documents: int = 5, bits: int | None = None) -> tuple[Aside, DataFrame]:
    """The input set aside, with ``left`` (its text less its repeated lines),
    ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lowered. A
    key of at least ``least`` code points that ``documents`` documents hold
    loses its lines everywhere but in the largest doc_id.

    Null and empty texts are one empty line. Rows that repeat a doc_id are one
    document when holders are counted; each loses lines of its own. A row
    without doc_id counts for no document and keeps no key.
    """
    aside = Aside(docs)
    drops = repeated_lines(docs, least, documents, bits).toDF("_id", "_key", "_drop")
    same = aside.rows["doc_id"].eqNullSafe(drops["_id"]) & (aside.rows["text_key"] == drops["_key"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    rest = F.concat_ws("\n", F.transform(kept, lambda i: F.get("_lines", i)))
    return aside, aside.rows.join(drops, same, "left").withColumn("_lines", F.split(text, "\n")).withColumns(
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
            "left": F.when(F.col("_drop").isNull(), F.col("text")).otherwise(rest),
        }
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The input without its repeated lines, all columns kept; ``n_chars``,
    where there is one, is that of the new text."""
    aside, rows = lines_left(docs, **options)
    new = {aside.column("text"): F.col("left")}
    if "n_chars" in aside.names:
        old = F.col(aside.column("n_chars"))
        new[aside.column("n_chars")] = F.when(F.col("n_dropped") > 0, F.char_length("left").cast("long")).otherwise(old)
    return aside.restore(rows.withColumns(new))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the lines left of every row;
    nulls, repeated rows and ties as in ``lines_left``."""
    _, rows = lines_left(docs, **options)
    return rows.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("left", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
