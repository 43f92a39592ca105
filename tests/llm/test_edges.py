"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and
columns with clashing names: every operator and every stage has a result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from xtalframe.llm import (
    decontamination,
    line_dedup,
    ngram_join,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
    simhash,
    suffix_dedup,
    token_alignment,
    token_counts,
    toxicity,
)
from xtalframe.llm.common import ship

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "rare pair")]
LABELS = [(1, 0, 0), (2, 0, 1), (3, None, None), (None, 1, 1)]
LINE = "a line that is long enough to be looked at by the filters\n"
ROWS = [
    (1, "plain words here", "en"),
    (1, "plain words here", "en"),
    (1, "another text under the same id", None),
    (2, None, "en"),
    (3, "", None),
    (None, "text without an id", "en"),
    (None, None, None),
    (4, "x" * 70_000, "en"),
    (5, LINE * 900, "en"),
    (6, "One two three four five six seven eight nine ten; eleven", "en"),
    (7, " \n\t ", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    # names that clash with inner ones, and by case
    return df.select("doc_id", "text", "lang", F.lit(1).alias("c0"), F.lit("x").alias("text_key"), F.lit(2).alias("n"), F.lit(3).alias("TEXT"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("w"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("w"))


def one(fn):
    return lambda d, i, la: fn(d)


OPERATORS = {
    "suffix": one(lambda d: suffix_dedup.remove_repeats(d)),
    "secrets": one(secret_scan.scan_secrets),
    "shards": one(lambda d: sharding.minimax_shards(d, shards=3)),
    "toxicity": lambda d, i, la: toxicity.toxicity(d, la),
    "decontamination": lambda d, i, la: decontamination.contamination(d, i),
    "counts": one(token_counts.count_tokens),
    "lines": one(line_dedup.digests),
    "jaccard": one(lambda d: ngram_join.near_duplicates(d)),
    "quality": one(quality_rules.ledger),
    "encode": one(sentencepiece_codec.encode_decode),
    "digests": one(sentencepiece_codec.digests),
    "simhash": one(simhash.near_duplicates),
    "alignment": one(token_alignment.align),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(name, docs, items, labels):
    rows = OPERATORS[name](docs, items, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["doc_id"] is not None) == sorted(
        (False, r[0]) for r in ROWS if r[0] is not None
    )
    assert sum(r["doc_id"] is None for r in rows) == 2
    repeated = [tuple(v for k, v in r.asDict().items() if k != "slot") for r in rows if r["doc_id"] == 1]
    assert len(repeated) == 3 and len(set(map(str, repeated))) <= 2  # equal rows have equal results


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, items, labels):
    assert OPERATORS[name](docs.limit(0), items.limit(0), labels.limit(0)).collect() == []


def test_defined_results(docs, items, labels):
    by = lambda rows, key: {r["doc_id"]: r[key] for r in rows if r["doc_id"] not in (None, 1)}
    hit = decontamination.contamination(docs, items).collect()
    assert by(hit, "n_hit") == {2: 0, 3: 0, 4: 0, 5: 0, 6: 11, 7: 0}
    near = by(ngram_join.near_duplicates(docs).collect(), "component_id")
    assert near == {k: k for k in near}
    cut = by(suffix_dedup.remove_repeats(docs).collect(), "n_removed")
    assert cut == {2: 0, 3: 0, 4: 70_000 - 1, 5: len(LINE) * 899 + 0, 6: 0, 7: 0}
    toxic = by(toxicity.toxicity(docs, labels).collect(), "predicted")
    assert toxic == {k: 0 for k in toxic}


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns(k, spark, docs, items, labels, tmp_path):
    items.drop("words").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0
    if k < 4:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = sorted(str(r[0]) for r in out.collect())
    lost = {2: [], 3: ["6"]}.get(k, [])
    assert kept == sorted(str(r[0]) for r in ROWS if str(r[0]) not in lost)


def test_texts_larger_than_a_part(spark, labels):
    """Rows of more bytes than are worked on at once, beside small ones."""
    words = [f"w{k * 7919 % 100_003}" for k in range(260_000)]
    long = " ".join(words)
    assert len(long) > 1_500_000
    rows = [(1, long), (2, long + " and a tail"), (3, "short"), (4, "\n".join(words[:130_000]) + "\n" + "x" * 60 + "\n" + "y" * 1_200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    size = {d: len(t) for d, t in rows}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    grams = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in rows)}
    assert near == {d: (len(grams[d]), 3 if d == 3 else 1) for d in size}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}[2] == 1
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert {d: n for d, (n, _) in cut.items()} == size
    # the words repeat after 100,003; what runs on into the tail does not
    first = len(" ".join(words[:100_003])) + 1
    assert cut[1][1] == size[1] - first and size[2] - 120 < cut[2][1] <= size[2] and cut[3][1] == 0
    assert {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()} == {d: 0 for d in size}
    tokens = {r["doc_id"]: r["n_tokens"] for r in sentencepiece_codec.digests(docs).collect()}
    pairs = {r["doc_id"]: (r["n_b"], r["n_links"], r["n_a"], r["n_groups"]) for r in token_alignment.align(docs).collect()}
    assert {d: p[0] for d, p in pairs.items()} == tokens
    assert all(links == a + b - groups for b, links, a, groups in pairs.values())
    lines = {r["doc_id"]: r["n_lines"] for r in line_dedup.digests(docs).collect()}
    assert lines == {1: 1, 2: 1, 3: 1, 4: 130_002}
