"""Expectations of single operators."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerspark import api, config, reports
from ledgerspark.functions import estimates, instances
from ledgerspark.functions.fingerprint import fingerprint, normalized
from ledgerspark.operators import costs
from ledgerspark.operators.attribution import overlap_join
from ledgerspark.plans import cells, delta_log, explain, graphs, lint, rules
from ledgerspark.sources import corpus, runtime
from ledgerspark.plan_queries import best_scenario
from ledgerspark.queries import ORACLE_SQL
from ledgerspark.sources.registry import TableRegistry, access_report
from ledgerspark.streaming.usage import streaming_tag_costs

from .oracle import TABLES, compare


def sources(spark, *rows):
    return spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(rows)], "path string, language string, content string")


def codes(df):
    return sorted((r["code"], r["line_no"]) for r in df.collect())


@pytest.mark.parametrize("text, want", [
    ("select 1 -- x\nfrom t", "SELECT ? FROM T"), ("select a /* b\nc */ from  t", "SELECT A FROM T"), ("a IN (1, 'x',2)", "A IN (?)"), ("t123", "T1?"), ("4e5", "4E5"), ("'it''s'", "??"), ("x = 1.5", "X = ?")])
def test_normal_form(spark, text, want):
    assert spark.range(1).select(normalized(F.lit(text))).first()[0] == want


def test_fingerprint_of_nothing(spark):
    assert [r[0] for r in spark.sql("select explode(array('', null)) t").select(fingerprint(F.col("t"))).collect()] == ["unknown", "unknown"]


def test_identifier():
    assert costs.identifier("a-b_1") == "a-b_1"
    for bad in ("", "a b", "x'", "y" * 257):
        with pytest.raises(ValueError):
            costs.identifier(bad)


def test_overlap_join_is_closed_and_keeps_each_pair_once(spark):
    t = lambda *x: spark.createDataFrame(x, "k int, s string, e string, n string").selectExpr("k", "cast(s as timestamp_ntz) s", "cast(e as timestamp_ntz) e", "n")
    a = t((1, "2024-01-01 00:00", "2024-01-04 00:00", "a"), (1, None, "2024-01-09", "b"))
    b = t((1, "2024-01-02 00:00", "2024-01-09 00:00", "x"), (1, "2024-01-04 00:00", None, "y"), (1, "2024-01-05 00:00", None, "z"), (2, "2024-01-02 00:00", None, "w"))
    got = overlap_join(a, b.withColumnsRenamed({"s": "s2", "e": "e2", "n": "m"}), ["k"], ("s", "e"), ("s2", "e2"))
    assert sorted((r["n"], r["m"]) for r in got.collect()) == [("a", "x"), ("a", "y")]


def test_strict_rules(spark):
    s = sources(spark, ("sql", "select a from t union select b from u"), ("sql", "select 1 from a cross join b"), ("sql", "select a from t order by a"))
    assert {c for c, _ in codes(lint.findings(s, strict=True))} == {"BQ002", "SQ003", "BP013"}
    assert codes(lint.findings(s)) == []


def test_limited_collect_and_empty(spark):
    assert codes(lint.findings(sources(spark, ("python", "x = t.limit(5).collect()"), ("python", ""), ("sql", ""), ("python", None)))) == []


def test_check_and_suppression(spark, tmp_path):
    (tmp_path / "a.py").write_text("y = t.collect()\nz = t.toPandas()  # ledger: ignore\n")
    (tmp_path / "b.sql").write_text("select * from t")
    assert codes(api.check(spark, str(tmp_path))) == [("BP008", 1), ("SQ001", 1)]
    assert codes(api.check(spark, "select * from t")) == [("SQ001", 1)]
    assert codes(api.check(spark, "select * from t", config.Settings(ignore=("SQ",)))) == []
    assert reports.gate(lint.findings(sources(spark, ("sql", "select * from t"))), rules.rules_table(spark)) == 0


def test_file_wide_suppression(spark):
    s = sources(spark, ("python", "# ledger: ignore-file[pyspark]\nq = t.collect()\ndf = 1"))
    assert codes(api.check_sources(s)) == [("BNT-N01", 3)]


def test_cycles_leave_diamonds(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert sorted(r[0] for r in cells.cycles(e).collect()) == ["x", "y"]


def test_graph_cost(spark):
    nodes = graphs.sql_nodes(sources(spark, ("sql", "create table o as select a from t group by a"), ("sql", "select a from t")))
    sized = graphs.enriched(nodes, spark.createDataFrame([("t", 2_000_000_000)], "target string, bytes bigint"))
    out = {r["path"]: r for r in graphs.graph_cost(sized).collect()}
    assert out["f0"]["cost"] == pytest.approx(2 + 6 + 2) and not out["f0"]["driver_bound"]
    assert out["f1"]["driver_bound"]


def test_explain_of_a_real_plan(spark):
    df = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    text = df._jdf.queryExecution().explainString(df._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost")) if hasattr(df, "_jvm") else spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "cost")
    row = explain.explain_stats(spark.createDataFrame([("x", text)], "plan_id string, text string")).first()
    assert row["total_size_bytes"] > 0
    assert explain.own_stats(df)[0] > 0


def test_delta_log(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    (log / "00000000000000000000.json").write_text(json.dumps({"add": {"path": "a", "size": 1000, "stats": json.dumps({"numRecords": 5})}}) + "\nnot json\n" + json.dumps({"add": {"path": "b", "size": 2000}}) + "\n")
    (log / "00000000000000000001.json").write_text(json.dumps({"remove": {"path": "a"}}) + "\n" + json.dumps({"add": {"path": "c", "size": 10, "stats": json.dumps({"numRecords": 7})}}) + "\n")
    live = delta_log.live_files(delta_log.read_log(spark, str(tmp_path / "t")))
    assert sorted(r["path"] for r in live.collect()) == ["b", "c"]
    assert tuple(delta_log.table_stats(live).first()) == (2, 2010, None)
    assert tuple(delta_log.table_stats(live.where("path = 'c'")).first()) == (1, 10, 7)
    assert tuple(delta_log.table_stats(live.where("false")).first()) == (0, 0, None)


def test_table_detail(spark):
    spark.range(10).write.mode("overwrite").saveAsTable("detail_probe")
    row = delta_log.detail(spark, "detail_probe").first()
    assert row["num_files"] >= 1 and row["size_bytes"] > 0 and row["partition_columns"] == [] and "detail_probe" in row["location"]
    spark.sql("drop table detail_probe")


def test_notebooks(spark, tmp_path):
    book = {"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["%sql\n", "select 1"]}, {"cell_type": "code", "source": "x = 1"}], "metadata": {"kernelspec": {"language": "python"}}}
    (tmp_path / "n.ipynb").write_text(json.dumps(book))
    with zipfile.ZipFile(tmp_path / "a.dbc", "w") as z:
        z.writestr("m.python", json.dumps({"language": "python", "commands": [{"commandText": "y = 2"}, {"commandText": "select 2", "language": "sql"}]}))
        z.writestr("junk", "no json")
    got = [(r["cell_index"], r["language"], r["source"]) for r in corpus.notebook_cells(spark, str(tmp_path)).orderBy("cell_index").collect()]
    assert got == [(1, "sql", "%sql\nselect 1"), (2, "python", "x = 1")]
    assert [(r["cell_index"], r["language"], r["source"]) for r in corpus.archive_cells(spark, str(tmp_path)).orderBy("cell_index").collect()] == [(0, "python", "y = 2"), (1, "sql", "select 2")]


def test_cluster_json(spark):
    payload = json.dumps({"node_type_id": "n", "autoscale": {"min_workers": 2, "max_workers": 9}, "runtime_engine": "PHOTON", "azure_attributes": {"availability": "SPOT_WITH_FALLBACK_AZURE"}})
    row = corpus.cluster_configs(spark.createDataFrame([(1, payload)], "id int, payload string")).first()
    assert tuple(row) == (1, "n", "n", 2, 9, True, True)


def test_event_log(spark, tmp_path):
    lines = [
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 0, "Number of Tasks": 2, "Accumulables": [{"Name": "internal.metrics.executorCpuTime", "Value": 2_000_000_000}]}},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 3, "description": "q", "time": 1000},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd", "executionId": 3, "time": 3500}]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, lines)))
    events = runtime.event_log(spark, str(tmp_path / "log"))
    assert runtime.stage_metrics(events).first()["cpu_seconds"] == 2.0
    assert tuple(runtime.sql_executions(events).first()) == (3, "q", 2.5)


def test_right_sizing(spark):
    near = {r[0]: tuple(r)[1:] for r in instances.neighbours(instances.catalog(spark)).collect()}
    assert near["Standard_DS3_v2"] == ("Standard_D2ds_v4", "Standard_DS4_v2") and near["Standard_D64s_v3"][1] is None
    w = spark.sql("select 4 n, 10 c, 10 m union all select 2, 90, 10 union all select null, 50, 50").select(instances.right_sized(F.col("n"), F.col("c"), F.col("m"))).collect()
    assert [r[0] for r in w] == [3, 4, 2]
    assert spark.range(1).select(instances.within_addresses(F.lit(8), F.lit(5))).first()[0] == 4


def test_step_failure_is_null(spark):
    assert spark.range(1).select(estimates.step_failure(F.lit(2e9), F.lit(1.0))).first()[0] is None


def test_best_scenario_of_ties_and_unknown_values(spark, sf_dir, tmp_path):
    rows = [
        *[(1, 3, 17, 1.0, 50.0, 0.1), (1, 7, 9, 1.0, 60.0, 0.1)],  # the part number decides, not the line's
        *[(2, 1, 100, 5.0, 50.0, 0.1), (2, 2, 20, 5.0, 50.0, 0.1), (2, 3, 3, 5.0, 50.0, 0.0)],
        *[(3, 1, 1, 5.0, 0.0, 0.1), (3, 2, 2, 5.0, 9.0, 0.1)],
        *[(4, 1, 1, 5.0, None, 0.1), (4, 2, 2, 1.0, 9.0, 0.1)],
        *[(5, 1, 1, 5.0, 8.0, None), (5, 2, 2, None, 8.0, 0.0), (5, 3, None, 5.0, 1.0, 0.0)],
        *[(6, 1, None, 5.0, 8.0, 0.1), (None, None, None, None, None, None), (None, 2, 5, None, None, None)],
    ]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    lines.withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "lineitem.parquet"))
    for t in set(TABLES) - {"lineitem"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    compare(spark, str(tmp_path), best_scenario, ORACLE_SQL["best_scenario"])
    scenarios = spark.createDataFrame([(1, "a", 0.0, 1.0), (1, "b", None, 2.0), (1, "c", 9.0, 0.5), (1, "d", 9.0, None), (1, "e", 9.0, 0.5)], "grp int, name string, cost double, confidence double")
    assert estimates.best_scenario(scenarios).first()["best"] == "c"
    assert estimates.best_scenario(scenarios.where("name < 'c'")).first()["best"] == "b"


def test_reports(spark):
    df = spark.createDataFrame([("drift", "job:1", 0.3), ("idle", "c", 2.0), ("total", "usd", 0.0)], "monitor string, key string, value double")
    assert reports.watch_message(df) == "Cost watch\ndrift job:1: +30.0%\nidle c: $2.00 wasted"
    assert reports.markdown(df).startswith("| monitor | key | value |\n| --- |")
    assert "<td>job:1</td>" in reports.html_table(df) and "job:1" in reports.terminal(df) and len(reports.json_lines(df)) == 3
    seen = []

    def broken(_):
        raise OSError("down")

    assert reports.dispatch("m", [("slack", seen.append), ("teams", broken)]) == {"slack": "sent", "teams": "failed: down"} and seen == [{"text": "m"}]
    reports.append_alert(spark, "alerts_probe", "watch", "warning", "m", "2024-01-01 00:00:00")
    assert spark.table("alerts_probe").count() == 1
    spark.sql("drop table alerts_probe")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "ledgerspark.toml").write_text('days = 9\nignore = ["SQ"]\n')
    monkeypatch.setenv("LEDGERSPARK_FAIL_ON", "warning")
    s = config.load(tmp_path, tag_key="team")
    assert (s.days, s.ignore, s.fail_on, s.tag_key) == (9, ("SQ",), "warning", "team")
    with pytest.raises(ValueError):
        config.load(tmp_path, nonsense=1)


def test_registry_and_watch(spark, sf_dir):
    from ledgerspark.sources import adapters as A

    A.usage_from_events(spark, sf_dir).createOrReplaceTempView("my_usage")
    A.list_prices(spark).createOrReplaceTempView("my_prices")
    registry = TableRegistry(billing_usage="my_usage", billing_list_prices="my_prices")
    assert registry.format_sql("select * from system.billing.usage") == "select * from my_usage"
    frames, status = api.watch(spark, "2024-01-31 00:00:00", config.Settings(tag_key="team"), registry)
    assert status["tag"] == status["drift"] == "ok" and status["idle"].startswith("failed") and frames["tag"].count() > 1
    report = {r[0]: r[1] for r in access_report(spark, registry).collect()}
    assert report["my_usage"] == "OK" and report["system.query.history"] == "NO ACCESS"


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from ledgerspark.sources import adapters as A

    usage, prices = A.usage_from_events(spark, sf_dir), A.list_prices(spark)
    a, b = (costs.cost_drift(u, prices, "2024-01-31 00:00:00").collect() for u in (usage, usage.repartition(7).orderBy(F.rand(1))))
    assert a == b


def test_streaming_tag_costs(spark, sf_dir, tmp_path):
    from ledgerspark.sources import adapters as A

    A.usage_from_events(spark, sf_dir).withColumn("usage_start_time", F.col("usage_start_time").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = streaming_tag_costs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), A.list_prices(spark), "team", "1 day", "1 hour")
    q = out.writeStream.format("memory").queryName("tag_stream").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.table("tag_stream").agg(F.round(F.sum("total_cost_usd"), 4)).first()[0]
    assert total == costs.priced(A.usage_from_events(spark, sf_dir), A.list_prices(spark)).agg(F.round(F.sum("cost").cast("double"), 4)).first()[0]
