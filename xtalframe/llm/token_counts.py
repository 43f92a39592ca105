"""Token counts of a unigram vocabulary without building the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from xtalframe.llm.common import texts
from xtalframe.llm.vocabulary import Recent, Vocabulary, default_model, load, marked, words_of

CACHE = 600_000
UNKNOWN_PENALTY = 10.0  # fixed value: what a unigram tokenizer takes off for a character it lacks
SCHEMA = "doc_id long, n_chars long, n_words long, n_tokens long, score double"


class Counter:
    """Best score and piece count of words, by dynamic programming.

    Matches come from the automaton by their end. At each place the best score
    wins; among equal scores the match that starts first, as the tokenizer
    walks starts from left to right and replaces only on a greater score. A
    character no piece covers alone may stand as unknown, at the lowest score
    less the penalty; it counts as many pieces as it has bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.ids.values()) - UNKNOWN_PENALTY
        self.words = Recent(CACHE, lambda word: self.viterbi(marked(word)))

    def viterbi(self, word: str) -> tuple[int, float]:
        scores, n = self.v.scores, len(word)
        if not self.v.characters.issuperset(word):
            return self.with_unknown(word)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        # matches come by their end; of those with one end, the longest first
        for end, (i, k) in self.v.automaton.iter(word):
            start = end + 1 - k
            score = best[start] + scores[i]
            if score > best[end + 1]:
                best[end + 1] = score
                count[end + 1] = count[start] + 1
        return count[n], best[n]

    def with_unknown(self, word: str) -> tuple[int, float]:
        """Every unknown character ends all pieces, so what lies between them
        is walked by itself; each adds its score and its bytes."""
        count, score, start = 0, 0.0, 0
        for at, c in enumerate([*word, None]):
            if c is None or c not in self.v.characters:
                if at > start:
                    n, s = self.viterbi(word[start:at])
                    count, score = count + n, score + s
                if c is not None:
                    count, score = count + len(c.encode()), score + self.unknown
                start = at + 1
        return count, score


@lru_cache(maxsize=1)
def kept_counter(path: str) -> Counter:
    """One counter for each Python worker, so that later tasks find its words."""
    return Counter(load(path))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces and score of every whole text, one row per input row, no shuffle.

    Spaces become markers and one marker stands before the text; no piece
    crosses from a word into the next space, so words are counted one by one
    and remembered (up to ``CACHE`` in a worker). Scores of the vocabulary are
    whole numbers, so their sums are exact in any order. Null and empty texts
    have no pieces and score 0; repeated rows are rows of their own.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                words = counter.words
                found = [words[w] for w in words_of(text)]
                rows.append((len(text), len(found), sum(c for c, _ in found), float(sum(s for _, s in found))))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
