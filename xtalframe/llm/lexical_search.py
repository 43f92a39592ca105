"""Ranked lexical search: item tiles times document tiles as dense products."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from xtalframe.llm.common import texts, written
from xtalframe.llm.textbytes import SEPARATORS

#: Distinct (item, term) pairs that one pass over the documents takes, about.
BLOCK_PAIRS = 1 << 18
CELLS = 1 << 20
DOCUMENT_TILE = 256
TERM_TILE = 4096
#: float64 holds every whole number below this.
EXACT = 1 << 53
#: No term adds more to a document than its weight times this.
MOST_IMPACT = 1_000_000
BUCKETS = 64
_TERMS = bytes(0x20 if SEPARATORS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
FOUND = "doc_id long, n long, terms binary, tf binary"
HITS = "item int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lowered."""
    return text.translate(_TERMS).split()


class Tile(NamedTuple):
    """Some items and the terms they have, as postings: item (its row), term
    (its column) and weight."""

    items: np.ndarray
    terms: np.ndarray
    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray

    def cuts(self, width: int = TERM_TILE, exact: int = EXACT) -> list[tuple[slice, np.ndarray]]:
        """Ranges of terms with their dense weights (items by terms): at most
        ``width`` terms, and no more than keep every sum of products below
        ``exact``."""
        out, start = [], 0
        while start < len(self.terms):
            mine = (self.column >= start) & (self.column < start + width)
            w = np.zeros((len(self.items), min(width, len(self.terms) - start)))
            w[self.row[mine], self.column[mine] - start] = self.weight[mine]
            most = np.cumsum(w * MOST_IMPACT, axis=1).max(0)
            n = max(1, int(np.searchsorted(most, exact)))
            out.append((slice(start, start + min(n, w.shape[1])), w[:, :n]))
            start = out[-1][0].stop
        return out


def tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, cells: int = CELLS) -> list[Tile]:
    """Tiles over the pairs (item, term), by item; terms of weight zero are
    left out. A tile takes items until it has ``cells`` cells; one item alone
    may have more."""
    keep = weight[term] > 0
    item, term = item[keep], term[keep]
    order = np.lexsort((term, item))
    item, term = item[order], term[order]
    starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, int)
    ends = np.append(starts[1:], len(item))
    out, k = [], 0
    while k < len(starts):
        first = last = k
        while last + 1 < len(starts) and (last + 2 - first) * (ends[last + 1] - starts[first]) <= cells:
            last += 1
        pick = slice(starts[first], ends[last])
        terms, column = np.unique(term[pick], return_inverse=True)
        items, row = np.unique(item[pick], return_inverse=True)
        out.append(Tile(items, terms, row, column, weight[term[pick]].astype(float)))
        k = last + 1
    return out


class Best:
    """The best documents of every item of a tile so far: highest score first,
    then smallest doc_id, null last. What ties with the last place is kept until
    doc_ids have decided."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)  # a score below can't be among the best
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.least[:, None]).any(1)):
            at = np.flatnonzero(scores[i] >= self.least[i])
            s = np.concatenate([self.score[i], scores[i, at]])
            d, n = np.concatenate([self.doc[i], doc[at]]), np.concatenate([self.null[i], null[at]])
            order = np.lexsort((d, n, -s))[: self.top]
            self.score[i], self.doc[i], self.null[i] = s[order], d[order], n[order]
            if len(order) == self.top:
                self.least[i] = s[order[-1]]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def scores_of(cuts: list, terms: np.ndarray, items: int, column: np.ndarray, row: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
    """Items by documents, whole numbers: sums of exact products. ``column``,
    ``row`` and ``impact`` are the documents' postings: term, document, value."""
    place = np.searchsorted(terms, column)
    place[place == len(terms)] = 0
    mine = terms[place] == column
    place, row, impact = place[mine], row[mine], impact[mine]
    total = np.zeros((items, documents), np.int64)
    for cut, weights_ in cuts:
        here = (place >= cut.start) & (place < cut.stop)
        dense = np.zeros((cut.stop - cut.start, documents))
        dense[place[here] - cut.start, row[here]] = impact[here]
        total += (weights_ @ dense).astype(np.int64)
    return total


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the vocabulary's terms in every row with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                ids = np.array([t for t in map(get, found) if t is not None], np.int32)
                distinct, counts = np.unique(ids, return_counts=True)
                n.append(len(found))
                terms.append(distinct.astype("<i4").tobytes())
                tf.append(counts.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())],
                names=[f.split()[0] for f in FOUND.split(", ")],
            )

    return docs.mapInArrow(run, FOUND)


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term: each task sums its own, then all are
    added. ``terms`` is bounded by the block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for row in batch.column(0):
                df[np.frombuffer(row.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    summed = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in summed.collect():
        out[term] = df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def hits(found: DataFrame, item_tiles: list[Tile], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Every task's best documents of every item."""
    shared = found.sparkSession.sparkContext.broadcast(item_tiles)

    def documents(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        doc, null = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
        m = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in part.column(1).to_pylist()], np.int64)
        terms = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column(2)]
        row = np.repeat(np.arange(part.num_rows), [len(t) for t in terms])
        tf = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in part.column(3)]).astype(np.int64)
        return doc, null, np.concatenate(terms), row, impacts(tf, m[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(t.items), top) for t in shared.value]
        for batch in batches:
            parts = [documents(batch.slice(k, DOCUMENT_TILE)) for k in range(0, batch.num_rows, DOCUMENT_TILE)]
            for tile, kept in zip(shared.value, best):
                cuts = tile.cuts()
                for doc, null, column, row, value in parts:
                    kept.add(scores_of(cuts, tile.terms, len(tile.items), column, row, value, len(doc)), doc, null)
        for tile, kept in zip(shared.value, best):
            lengths = [len(s) for s in kept.score]
            if sum(lengths):
                ids = pa.array(np.concatenate(kept.doc), mask=np.concatenate(kept.null))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(tile.items, lengths), pa.int32()), ids, pa.array(np.concatenate(kept.score))],
                    names=[f.split()[0] for f in HITS.split(", ")],
                )

    return found.mapInArrow(run, HITS)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each pair once. Columns are taken by exact name."""
    plain = items.toDF(*[f"c{k}" for k in range(len(items.columns))])
    pick = lambda name: F.col(f"c{items.columns.index(name)}")
    separated = F.regexp_replace(pick("text").cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    lowered = F.translate(separated, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.array_remove(F.array_distinct(F.split(lowered, " ")), "")).alias("term")
    return plain.select(pick("item_id").alias("item_id"), term).distinct().withColumn("term", F.col("term").cast("binary"))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """At most ``top`` rows an item. Each bucket of an item's rows is cut first,
    so no task sorts what all tasks together have found for one item."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    first = Window.partitionBy("item", "bucket").orderBy(*_order())
    rows = rows.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return rows.drop("bucket", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*_order()))).where(
        F.col("rank") <= top
    )


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item.

    A term is worth floor(1000 ln((2N+2)/(2df+1))); a document with it adds
    weight * (1e9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, once for each
    term of the item; whole numbers throughout. Documents are read in blocks of
    rows against compact tiles of items: a tile holds its items' terms only, and
    weights times impacts is one dense product in float64. Terms of a tile are
    cut where sums could reach 2**53, so that every product is exact.

    The items are the stated queries and are taken in blocks of about
    ``block_pairs`` (item, term) pairs, one pass over the documents each; what
    is broadcast is bounded by a block. Each task hands on its best documents.

    Equal scores rank by doc_id, null last; rows that repeat a doc_id are
    documents of their own. Rows of one item_id are one item (null too): the
    terms of all its texts. Null and empty texts have no terms; such items, and
    items no document shares a term with, have no rows. Very long texts take
    memory in proportion to their terms. Columns besides the ids and texts are
    not looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    read = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    pairs = written(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)))
    out = None
    for block in range(blocks):
        mine = pairs.where(F.col("block") == block).select("item_id", "term").toArrow()  # bounded by a block
        names = mine.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        words = mine.column("term").combine_chunks().dictionary_encode()
        vocabulary = {w: k for k, w in enumerate(words.dictionary.to_pylist())}
        found = written(postings(read, vocabulary), "postings")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(found, len(vocabulary))
        weight = np.where(df > 0, weights(df, n_docs), 0)  # a term no document has adds nothing
        item_tiles = tiles(names.indices.to_numpy(), words.indices.to_numpy(), weight)
        best = _ranked(hits(found, item_tiles, n_docs, n_terms, top), top)
        kind = pairs.schema["item_id"].dataType
        asked = spark.createDataFrame([(k, x) for k, x in enumerate(names.dictionary.to_pylist())], StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
        ranked = best.join(asked, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
