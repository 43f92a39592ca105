"""Toxicity by weak supervision: voters, a label model, a linear classifier."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import Aside, texts, written
from xtalframe.llm.textbytes import SEPARATORS, hash_of_word, parts, word_hashes

#: Insults that are rarely anything else; one voter each.
LEXICON = (
    "airhead asshole bastard bitch blockhead bonehead bullshit clown coward creep cretin degenerate dimwit dirtbag "
    "disgrace disgusting dumb dumbass dunce fool freak fuck fucking garbage halfwit hideous idiot imbecile jerk "
    "loser lowlife lunatic maggot moron nitwit parasite pathetic psycho repulsive revolting scum scumbag shit "
    "sleazebag slut stupid trash twit ugly vermin weirdo whore worthless"
).split()
SAMPLE = 20_000
CHUNK = 2048  # labelled rows that the fit works on at once
LEARNED = 512
LEAST = 5  # rows that a learned word is in
PURE = 0.8  # share of them that is toxic
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERNS = ("several", "repeated", "dense", "none")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class Model(NamedTuple):
    words: tuple[str, ...]
    weights: np.ndarray  # of the words' presence, then of the three totals, then the constant


def fold(doc_id):
    """0: held out; 1 to 4: labels may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def word_counts(data: np.ndarray, offsets: np.ndarray, words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x words: occurrences of every lexicon word; and words in all."""
    hashes, rows = word_hashes(data, offsets, SEPARATORS)
    known = np.array([hash_of_word(w.encode()) for w in words], np.uint64)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    hit = np.flatnonzero(known[order][at] == hashes)
    n = len(offsets) - 1
    counts = np.zeros((n, len(words)), np.int32)
    np.add.at(counts, (rows[hit], order[at[hit]]), 1)
    return counts, np.bincount(rows, minlength=n)


def features(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    total, distinct = counts.sum(1), (counts > 0).sum(1)
    density = np.minimum(1.0, 20.0 * total / np.maximum(n_words, 1))
    rest = np.column_stack([np.log1p(distinct), np.log1p(total), density, np.ones(len(total))])
    return np.hstack([(counts > 0).astype(float), rest])


def votes(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Rows x voters, true where a voter fires: the words, then ``PATTERNS``."""
    total, distinct = counts.sum(1), (counts > 0).sum(1)
    patterns = [distinct >= 2, total >= 3, 100 * total >= n_words, total == 0]
    return np.hstack([counts > 0, np.column_stack([p & (n_words > 0) if k < 3 else p for k, p in enumerate(patterns)])])


def label_model(fired: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of class 1 for every row, from the voters' agreement alone.

    Expectation-maximisation of how often each voter fires in either class.
    Voters that fire together more than the class explains are correlated; the
    evidence of each is divided by its correlation mass, so that a bundle of
    copies counts about once.
    """
    n, k = fired.shape
    x = fired.astype(float)
    toxic_side = np.ones(k, bool)
    toxic_side[-2] = False  # "none" speaks for class 0; the last column is the annotators' noisy label
    p1 = np.where(toxic_side, 0.3, 0.05)
    p0 = np.where(toxic_side, 0.01, 0.95)
    prior, share, q = 0.1, np.ones(k), np.zeros(n)
    for r in range(rounds):
        on, off = share * np.log(p1 / p0), share * np.log((1 - p1) / (1 - p0))
        z = np.log(prior / (1 - prior)) + x @ on + (1 - x) @ off
        q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        n1, n0 = q.sum(), n - q.sum()
        # firing rates with a small prior count; a voter never seen says nothing
        p1 = (q @ x + 0.3 * np.where(toxic_side, 1, 0.1)) / (n1 + 1)
        p0 = ((1 - q) @ x + np.where(toxic_side, 0.001, 0.95)) / (n0 + 1)
        p1, p0 = np.clip(p1, 1e-4, 1 - 1e-4), np.clip(p0, 1e-4, 1 - 1e-4)
        seen = x.any(0)
        p1[~seen] = p0[~seen] = 0.5
        prior = np.clip(n1 / n, 1e-3, 0.5)
        if r == rounds // 2:
            total, square = np.zeros(k), np.zeros((k, k))
            for at in range(0, n, CHUNK):  # the driver holds no second matrix of all rows
                part, w = x[at : at + CHUNK], q[at : at + CHUNK, None]
                rest = part - (w * p1 + (1 - w) * p0)
                total += rest.sum(0)
                square += rest.T @ rest
            sd = np.maximum(np.sqrt(np.maximum(np.diag(square) / n - (total / n) ** 2, 0)), 1e-9)
            rho = np.clip((square / n) / np.outer(sd, sd), 0, 1)
            rho[rho < 0.2] = 0
            np.fill_diagonal(rho, 1)
            share = 1 / rho.sum(1)
    return q


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - q) + penalty * w
        curve, bend = np.diag(penalty), p * (1 - p) + 1e-6
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            curve = curve + (part * bend[at : at + CHUNK, None]).T @ part
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def untrained(words: tuple[str, ...]) -> Model:
    """Where no labels can be learned from: any insult tips the score."""
    return Model(words, np.array([0.0] * len(words) + [6.0, 0.0, 0.0, -3.0]))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of about ``sample`` labelled rows at most, never held-out
    ones, chosen by a hash of their id."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n, parts_of = usable.count(), 1 << 20
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts_of)) < int(parts_of * sample / n))
    return texts(docs).join(F.broadcast(usable), "doc_id").select("text", "toxic")


def learned_words(train: DataFrame, most: int = LEARNED) -> list[str]:
    """Words that mark the labelled rows, whatever language they belong to.

    A word counts by what it says against the clean rows, not by its share of
    all toxic ones: the G statistic of toxic and word must pass what chance
    gives to the best of all words tested, and four of five of its rows must be
    toxic (labels are noisy, so clean ones may have it). Copies of a text are
    one text; the strongest ``most`` words are kept.
    """
    texts_once = train.distinct()
    n_toxic, n = texts_once.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    words = F.array_distinct(F.array_remove(F.split(F.translate("text", UPPER, LOWER), BETWEEN_WORDS), ""))
    tested = written(
        texts_once.select("toxic", F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST),
        "toxicity-words",
    )
    share, clean = n_toxic / n, F.col("n") - F.col("n1")
    gain = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    found = (
        tested.withColumn("g", 2 * (gain(F.col("n1"), share) + gain(clean, 1 - share)))
        .where((F.col("n1") >= LEAST) & (F.col("n1") >= PURE * F.col("n")) & (F.col("n1") > share * F.col("n")))
        # chance exceeds g with about exp(-g / 2): less than one word of all tested
        .where(F.col("g") >= 2 * math.log(max(1, tested.count())))
        .orderBy(F.desc("g"), "word")
        .limit(most)
    )
    return [r["word"] for r in found.collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Voters and classifier from a bounded sample of labelled rows."""
    rows = written(training_rows(docs, labels, sample), "toxicity-sample")
    n_toxic, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n or not n_toxic or n_toxic == n:
        return untrained(tuple(LEXICON))
    words = tuple(dict.fromkeys([*LEXICON, *learned_words(rows)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in parts(batch, 0):
                counts, total = word_counts(data, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts.tobytes() for counts in counts), pa.binary()), pa.array(total, pa.int64()), part.column(1)],
                    names=["counts", "n_words", "toxic"],
                )

    got = (
        rows.select(F.col("text").cast("binary").alias("data"), "toxic")
        .mapInArrow(count, "counts binary, n_words long, toxic int")
        .collect()
    )
    counts = np.array([np.frombuffer(r["counts"], np.int32) for r in got])
    n_words = np.array([r["n_words"] for r in got])
    noisy = np.array([r["toxic"] == 1 for r in got])
    del got
    q = label_model(np.hstack([votes(counts, n_words), noisy[:, None]]))
    return Model(words, fit_linear(features(counts, n_words), q))


def score(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, and the named
    further columns of the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_data"),
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "doc_id",
        *more,
    )
    out = read.select("doc_id", "held_out", *more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        for batch in batches:
            for part, data, offsets in parts(batch, 0):
                p = 1 / (1 + np.exp(-np.clip(features(*word_counts(data, offsets, words)) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(1), pa.array(p), pa.array(p >= 0.5).cast(pa.int32()), *part.columns[3:]],
                    names=["doc_id", "held_out", "score", "predicted", *more],
                )

    schema = out.add("score", "double").add("predicted", "integer")
    return read.mapInArrow(run, type(schema)([schema[c] for c in ("doc_id", "held_out", "score", "predicted", *more)]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score of every row.

    Voters: every word of the insult lexicon and of the words learned from
    labelled rows, patterns over them, and the annotators' own noisy label. A
    generative label model weighs them without believing any; a linear
    classifier then learns its posterior from words alone. The fit takes
    ``sample`` labelled rows at most (a parameter), of whose words the ``LEARNED``
    strongest, and never a row whose crc32(doc_id) mod 5 is 0; scoring covers
    all rows in one pass, in parts of about a megabyte, one text at least.

    Null and empty texts have no word and get the lowest score; repeated rows
    get equal scores; labels that are null or of unknown documents are left
    out; without usable labels the untrained lexicon decides. A null doc_id
    is not held out. A score of exactly 0.5 is predicted toxic; learned words
    that are equally strong are taken in order of their text. Columns besides
    doc_id and text, and doc_id and toxic of the labels, are not looked at. An
    empty table has no rows.
    """
    rows = score(texts(docs), train(docs, labels, sample))
    return rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": F.coalesce("held_out", F.lit(False))})


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns kept."""
    aside = Aside(docs)
    return aside.restore(score(aside.rows, train(docs, labels, sample), *aside.columns).where("predicted = 0"))
