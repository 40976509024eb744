"""Queries over a second corpus of sources: names, embedded SQL, statements, strict rules, pipelines, included sources;
and clusters and scenarios.  Their DuckDB texts hold the expected findings as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import estimates
from .plans import graphs, lint, rules, semantics
from .queries import registered
from .sources import corpus
from .sources.adapters import read

#: (language, content)
SOURCES = (
    ("python", "x = 1\ny = 2\nx = spark.read.table('t')\nif y:\n    x: int = 3"),
    ("python", "a = spark.sql('select 1 from t')\nb = spark.sql(f'''select * from {name}\nwhere c = 1''')\nc = spark.sql(text)"),
    ("sql", "select a from t;\nselec b from u;\nselect 'x;y' from v"),
    ("sql", "select * from a, b where a.i > 1"),
    ("sql", "select a from t cross join u order by a"),
    ("sql", "VACUUM t;\noptimize t;\nselect a from t union select b from u"),
    ("python", "# Databricks notebook source\nz = df.limit(3).where('a')\n# COMMAND ----------\nw = z"),
    ("python", "# Databricks notebook source\n# MAGIC %md\n" + "# COMMAND ----------\n" * 50),
    ("python", "@dlt.table\ndef a():\n    return spark.read.table('s')\n@dlt.table\ndef b():\n    return sdp.read('a')\n@dlt.table\ndef c():\n    return spark.sql('select * from LIVE.b join LIVE.gone')"),
    ("sql", "create materialized view m as select k from z;\ncreate streaming table n as select k from LIVE.m"),
    ("python", "@udf\ndef f(x):\n    return x\nimport pyspark.sql.functions as f\ng = f.pandas_udf(h)\n"),
    ("python", "def broken(:\n  pass"),
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content: a source for each document, by its id."""
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SOURCES]), (F.col("doc_id") % len(SOURCES) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("src_"), F.col("doc_id").cast("string")).alias("path"), pick(0).alias("language"), pick(1).alias("content"))


def _expected(columns: str, values: str, select: str) -> str:
    return f"SELECT 'src_' || doc_id AS path, {select} FROM documents JOIN (VALUES {values}) g(sid, {columns}) ON doc_id % {len(SOURCES)} = sid"


@registered(_expected("name, line, previous", "(0, 'x', 3, 1), (0, 'x', 5, 3)", "name, CAST(line AS INT) AS line_no, CAST(previous AS INT) AS previous_line"))
def shadowed_names(spark, sf_dir):
    return semantics.shadowed(semantics.bindings(sources(spark, sf_dir)))


@registered(_expected("seq, name, line, rhs, l, f", "(0, 0, 'x', 1, 'unknown', false, false), (0, 1, 'y', 2, 'unknown', false, false), (0, 2, 'x', 3, 'spark_read', false, false), (0, 3, 'x', 5, 'unknown', false, false), (1, 0, 'a', 1, 'unknown', false, false), (1, 1, 'b', 2, 'unknown', false, false), (1, 2, 'c', 4, 'unknown', false, false), (6, 0, 'z', 2, 'unknown', true, true), (6, 1, 'w', 4, 'unknown', false, false), (10, 0, 'g', 5, 'unknown', false, false)", "CAST(seq AS INT) AS seq, name, CAST(line AS INT) AS line_no, rhs, l AS has_limit, f AS has_filter"))
def name_bindings(spark, sf_dir):
    return semantics.bindings(sources(spark, sf_dir)).select("path", "seq", "name", "line_no", "rhs", "has_limit", "has_filter")


@registered(_expected("s, e, text, dynamic", "(1, 1, 1, 'select 1 from t', false), (1, 2, 3, 'select * from {name}' || chr(10) || 'where c = 1', true), (8, 9, 9, 'select * from LIVE.b join LIVE.gone', false)", "CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, g.text AS text, dynamic"))
def sql_fragments(spark, sf_dir):
    return semantics.sql_fragments(sources(spark, sf_dir))


@registered(_expected("code, line, severity", "(2, 'BN001', 2, 'error'), (11, 'BN001', 1, 'error')", "code, CAST(line AS INT) AS line_no, severity"))
def syntax_errors(spark, sf_dir):
    given = sources(spark, sf_dir)
    found = semantics.sql_plan_findings(given).unionByName(lint.syntax_findings(given).where("code = 'BN001'"))
    return rules.graded(found, rules.rules_table(spark))


_STRICT = (
    "(0, 'BN003', 3, 'warning'), (0, 'BN003', 5, 'warning'), (1, 'BN002', 2, 'warning'), (2, 'BN001', 2, 'error'), (3, 'SQ001', 1, 'warning'), (3, 'SQ002', 1, 'warning'), (4, 'SQ003', 1, 'error'), (4, 'BP013', 1, 'warning'), "
    "(5, 'BD001', 1, 'warning'), (5, 'BQ002', 3, 'warning'), (6, 'BP007', 1, 'info'), (7, 'BP006', 1, 'info'), (7, 'BP003', 2, 'warning'), (10, 'BP015', 5, 'info'), (11, 'BN001', 1, 'error')"
)


@registered(_expected("code, line, severity", _STRICT, "code, CAST(line AS INT) AS line_no, severity"))
def lint_strict(spark, sf_dir):
    return rules.graded(lint.findings(sources(spark, sf_dir), strict=True), rules.rules_table(spark))


@registered(_expected("src, dst, kind", "(8, 'a', 'b', 'sdp_read'), (8, 'b', 'c', 'live_ref'), (9, 'm', 'n', 'live_ref')", "src, dst, kind"))
def pipeline_edges(spark, sf_dir):
    return graphs.pipeline_edges(sources(spark, sf_dir))


_BOOKS = "l(path, line_no, line) AS (SELECT 'nb_' || n_nationkey, CAST(i AS INT), CASE i WHEN 1 THEN 'a = ' || n_nationkey WHEN 2 THEN '# MAGIC %run nb_' || ((n_nationkey * 3 + 1) % 30) ELSE 'b = 2' END FROM nation, (VALUES (1), (2), (3)) v(i))"


@registered(f"""WITH RECURSIVE {_BOOKS}, e(path, chain, line_no, line) AS (SELECT path, [path], line_no, line FROM l UNION ALL SELECT e.path, list_append(e.chain, l.path), l.line_no, l.line FROM e JOIN l ON e.line = '# MAGIC %run ' || l.path WHERE NOT list_contains(e.chain, l.path))
    SELECT path, CAST(len(chain) AS INT) AS depth, chain[-1] AS origin, line_no, line FROM e WHERE line_no <> 2 OR NOT EXISTS (SELECT 1 FROM l t WHERE e.line = '# MAGIC %run ' || t.path AND NOT list_contains(e.chain, t.path))""")
def run_spliced(spark, sf_dir):
    key = F.col("n_nationkey")
    texts = F.array(F.concat(F.lit("a = "), key.cast("string")), F.concat(F.lit("# MAGIC %run nb_"), ((key * 3 + 1) % 30).cast("string")), F.lit("b = 2"))
    lines = read(spark, sf_dir, "nation").select(F.concat(F.lit("nb_"), key.cast("string")).alias("path"), F.posexplode(texts).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return semantics.spliced(lines).select("path", F.size("at").alias("depth"), "origin", "line_no", "line")


_PAYLOAD = "'{\"node_type_id\": \"n' || (s_suppkey % 3) || '\", \"spark_version\": \"15.4' || CASE WHEN s_suppkey % 4 = 0 THEN '-photon' ELSE '' END || '\", ' || CASE WHEN s_suppkey % 2 = 0 THEN '\"num_workers\": ' || s_nationkey ELSE '\"autoscale\": {\"min_workers\": 2, \"max_workers\": ' || (s_nationkey + 2) || '}' END || ', \"azure_attributes\": {\"availability\": \"' || CASE WHEN s_suppkey % 5 = 0 THEN 'SPOT_AZURE' ELSE 'ON_DEMAND_AZURE' END || '\"}}'"


@registered("SELECT s_suppkey AS id, 'n' || (s_suppkey % 3) AS instance_type, 'n' || (s_suppkey % 3) AS driver_type, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 2 END AS INT) AS num_workers, CAST(CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey + 2 END AS INT) AS max_workers, s_suppkey % 4 = 0 AS photon, s_suppkey % 5 = 0 AS spot FROM supplier")
def cluster_json(spark, sf_dir):
    return corpus.cluster_configs(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_PAYLOAD).alias("payload")))


@registered("""WITH s AS (SELECT s_nationkey AS grp, 'sc_' || (s_suppkey % 3) AS name, max(CAST(s_acctbal AS DOUBLE)) AS cost, CAST(max(s_suppkey % 2) AS DOUBLE) AS confidence FROM supplier GROUP BY 1, 2), b AS (SELECT grp, cost AS base FROM s WHERE name = 'sc_0')
    SELECT grp, name, cost, confidence, base - cost AS saving, (base - cost) / nullif(base, 0) AS saving_pct, confidence >= 1 AS verified FROM s LEFT JOIN b USING (grp)""")
def scenario_comparison(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("grp"), F.concat(F.lit("sc_"), (F.col("s_suppkey") % 3).cast("string")).alias("name")).agg(F.max(F.col("s_acctbal").cast("double")).alias("cost"), F.max(F.col("s_suppkey") % 2).cast("double").alias("confidence"))
    return estimates.compared(rows, "sc_0")


@registered("SELECT 'src_' || doc_id AS path, CAST(CASE doc_id % " + str(len(SOURCES)) + " WHEN 7 THEN 51 WHEN 6 THEN 2 ELSE 1 END AS BIGINT) AS cells FROM documents")
def notebook_sizes(spark, sf_dir):
    c = F.col("content")
    return sources(spark, sf_dir).select("path", (F.regexp_count(c, F.lit(semantics.SEPARATOR)) + 1).cast("long").alias("cells"))
