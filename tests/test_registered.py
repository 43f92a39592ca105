"""Registered queries against their SQL, streaming replay, and plan shapes."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from tests.conftest import SF
from xtalframe.operators import gcn as N
from xtalframe.operators import graph as G
from xtalframe.plans import derived as V
from xtalframe.session import shared_folder
from xtalframe.streaming import ingest

QUICK = [
    "clean_tc",
    "best_entry_mp",
    "best_entry_oqmd",
    "best_by_element_set",
    "structure_edges",
    "pair_join_within",
    "feature_table",
    "split_three_way",
    "neighbor_aggregate",
    "evaluate_model",
    "validate_manual_row",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert len(entry(spark).collect()) == 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_edges_need_no_shuffle_for_small_structures(spark):
    df = G.structure_edges(V.structures(spark, SF))
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


@pytest.mark.parametrize("name", ["best_entry_mp", "join_candidates_elements", "feature_table", "gcn_score", "split_three_way", "baseline_compare"])
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_columns_are_pruned_at_the_scan(spark):
    text = plan(V.site_rows(spark, SF).groupBy("structure_id").count())
    assert "ReadSchema: struct<l_orderkey:bigint>" in text


def append(spark, base, source, log):
    stream = ingest.read_manual_rows(spark, f"{base}/{source}")
    ingest.append_validated(stream, f"{base}/data", f"{base}/bad", f"{base}/{log}").awaitTermination()
    return spark.read.parquet(f"{base}/data").count(), spark.read.parquet(f"{base}/bad").count()


def test_append_adds_sources_and_repeats_nothing(spark):
    base = shared_folder(spark, "stream")
    rows = V.manual_rows(spark, SF)
    rows.write.json(f"{base}/a")
    rows.limit(90).write.json(f"{base}/b")
    one = append(spark, base, "a", "log-a")
    assert sum(one) == rows.count() and min(one) > 0
    assert append(spark, base, "a", "log-a") == one  # nothing new
    two = append(spark, base, "b", "log-b")  # another source starts at batch 0 too
    assert sum(two) == sum(one) + 90
    assert append(spark, base, "a", "log-lost") == two  # a lost checkpoint repeats no file
    rows.limit(30).write.mode("append").json(f"{base}/a")
    assert sum(append(spark, base, "a", "log-lost")) == sum(two) + 30  # and new files still come


def test_a_batch_without_valid_rows_replaces_its_rows(spark):
    base = shared_folder(spark, "stream")
    rows = V.manual_rows(spark, SF).withColumn("source_file", F.lit("f"))
    for batch in (rows, rows.where("material_id IS NULL")):
        ingest.store_batch(batch, f"{base}/data", f"{base}/bad", "q", 0)
    assert spark.read.parquet(f"{base}/data").count() == 0
    assert spark.read.parquet(f"{base}/bad").count() == rows.where("material_id IS NULL").count()


def _one_file(spark, name, n=40):
    return V.manual_rows(spark, SF).limit(n).withColumn("source_file", F.lit(name))


def _stored(spark, base):
    out = []
    for table in ("data", "bad"):
        try:
            out += [r[0] for r in spark.read.parquet(f"{base}/{table}").select("source_file").collect()]
        except Exception as error:  # noqa: BLE001
            assert "UNABLE_TO_INFER" in str(error) or "PATH_NOT_FOUND" in str(error)
    return {f: out.count(f) for f in set(out)}


def test_crash_between_the_two_tables(spark, monkeypatch):
    """The dataset's folder is written, the quarantine's is not: the same query
    repeats the batch, another one takes it over; nothing is there twice."""
    for again in ("q", "other"):
        base = shared_folder(spark, "stream")
        ingest.store_batch(_one_file(spark, "f0"), f"{base}/data", f"{base}/bad", "q", 0)
        with monkeypatch.context() as m:
            m.setattr(ingest, "rejected", lambda rows: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                ingest.store_batch(_one_file(spark, "f1"), f"{base}/data", f"{base}/bad", "q", 1)
        assert 0 < _stored(spark, base)["f1"] < 40
        ingest.store_batch(_one_file(spark, "f1"), f"{base}/data", f"{base}/bad", again, 1)
        assert _stored(spark, base) == {"f0": 40, "f1": 40}
        # crash after both tables, before the commit
        with monkeypatch.context() as m:
            m.setattr(ingest.Manifest, "commit", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                ingest.store_batch(_one_file(spark, "f2"), f"{base}/data", f"{base}/bad", "q", 2)
        ingest.store_batch(_one_file(spark, "f2"), f"{base}/data", f"{base}/bad", again, 2)
        ingest.store_batch(_one_file(spark, "f2"), f"{base}/data", f"{base}/bad", "third", 0)
        assert _stored(spark, base) == {"f0": 40, "f1": 40, "f2": 40}


def test_a_batch_does_not_pay_for_history(spark, monkeypatch):
    """Runs are merged level by level: few are left, every file is in one, and a
    lookup reads the runs' ranges, not the stored rows."""
    from xtalframe.streaming import manifest

    monkeypatch.setattr(manifest, "FAN", 4)
    base = shared_folder(spark, "manifest")
    kept = manifest.Manifest(spark, f"{base}/data")
    for k in range(21):
        kept.commit([f"{k:02d}-{j}" for j in range(5)], "q", k)
    runs = {level: len(kept._children(f"{kept.path}/{level}")) for level in kept._children(kept.path)}
    assert runs == {"0": 1, "1": 1, "2": 1}
    assert kept.rows().count() == kept.rows().distinct().count() == 105
    assert kept.stored_by_others(["03-1", "20-4", "99-9"], "new") == {"03-1", "20-4"}
    assert kept.stored_by_others(["03-1"], "q") == set() and kept._committed("q", 3) and not kept._committed("q", 77)
    lookup = kept.rows().where(F.col("source_file").isin(["03-1"]) & (F.col("query_id") != "new"))
    assert "PushedFilters: [" in plan(lookup) and "source_file,03-1" in plan(lookup).replace("[", ",").replace("In(", "")


def test_network_scoring_shuffles(spark):
    """Messages are stored in buckets of their source node: a layer joins them as
    they lie, and only sums by target node are shuffled."""
    nodes = spark.range(10).selectExpr("id % 3 as structure_id", "id as node", "1.0D as x0", "2.0D as x1")
    edges = nodes.selectExpr("structure_id", "node as source_node_index", "node + 3 as target_node_index", "1.5D as distance")
    weights = {"w1": [[1, 1], [1, 1]], "b1": [0, 0], "w2": [[1, 1], [1, 1]], "b2": [0, 0], "w_out": [1, 1], "b_out": 0}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(N.gcn_score(nodes, edges, ["x0", "x1"], weights)).split("== Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "LeftOuter" not in text and "Generate" not in text  # no edge is made here
    assert len(re.findall(r"SortMergeJoin", text)) == 2
    assert len(re.findall(r"Bucketed: true", text)) >= 2
    exchanges = re.findall(r"Exchange (\w+)\(([^,)]*), ?([^,)]*)", text)
    assert len(exchanges) == 4 and not any("node" in b for _, _, b in exchanges)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The tables in twenty files each: more splits than cores."""
    folder = str(tmp_path_factory.mktemp("many"))
    for name in ("orders", "events", "lineitem", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(20).write.parquet(f"{folder}/{name}.parquet")
    return folder


READS = {  # of the whole input, over all jobs of the query
    "gcn_score": 1,
    "neighbor_aggregate": 1,
    "feature_table": 1,
    "best_entry_mp": 2,
    "union_splits": 2,
    "numeric_prep": 2,
    "split_three_way": 2,
    "best_entry_oqmd": 2,
}


@pytest.mark.parametrize("name", READS)
def test_input_is_read_few_times(spark, many_files, name):
    """Rows of the largest table that the query's stages read, counted by an
    accumulator of Spark's own: the status of all its jobs."""
    table = {"union_splits": "orders", "split_three_way": "orders", "numeric_prep": "part", "best_entry_oqmd": "lineitem"}.get(name, "orders")
    seen = []
    tracker = spark._jsparkSession.sharedState().statusStore()
    before = tracker.executionsCount()
    queries()[name](spark, many_files).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for k in range(before, tracker.executionsCount()):
        execution = tracker.executionsList(k, 1).head()
        graph = tracker.planGraph(execution.executionId())
        metrics = tracker.executionMetrics(execution.executionId())
        nodes = graph.allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if not node.name().startswith("Scan parquet") or f"{many_files}/{table}.parquet" not in node.desc():
                continue
            for j in range(node.metrics().size()):
                metric = node.metrics().apply(j)
                if metric.name() == "number of output rows" and metrics.contains(metric.accumulatorId()):
                    seen.append(int(str(metrics.apply(metric.accumulatorId())).replace(",", "").split(".")[0]))
    rows = spark.read.parquet(f"{many_files}/{table}.parquet").count()
    assert sum(seen) and round(sum(seen) / rows) <= READS[name], seen
