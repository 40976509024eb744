"""The supplied tables in the shape of system tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Open list prices; signup is missing on purpose, and click has a closed row.
PRICES = (("click", "0.30", None), ("view", "0.55", None), ("purchase", "0.70", None), ("error", "0.22", None), ("click", "9.99", "2023-12-31 00:00:00"), ("A", "0.30", None), ("N", "0.70", None))
TABLE_NAMES = ("alpha", "beta", "gamma", "delta", "sales", "stock", "visits")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    text = lambda c: c.cast("string")
    user = F.col("user_id")
    meta = F.struct(text(user % 20).alias("cluster_id"), text(user % 5).alias("warehouse_id"), F.when(user % 2 == 0, text(user)).alias("job_id"), text(F.col("event_id")).alias("job_run_id"), F.when(user % 2 == 1, text(user)).alias("dlt_pipeline_id"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), F.col("event_type").alias("sku_name"), F.col("value").cast("decimal(18,4)").alias("usage_quantity"), F.col("ts").alias("usage_start_time"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("usage_end_time"), meta.alias("usage_metadata"), F.when(k >= 10, F.create_map(F.lit("team"), text(k))).otherwise(F.create_map().cast("map<string,string>")).alias("custom_tags"))


def usage_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sku_name"), F.col("l_quantity").cast("decimal(18,4)").alias("usage_quantity"), F.col("l_shipdate").alias("usage_start_time"),
        (F.col("l_shipdate") + F.expr("interval 1 day")).alias("usage_end_time"), F.struct((F.col("l_suppkey") % 5).cast("string").alias("warehouse_id")).alias("usage_metadata"))


def list_prices(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{s}', named_struct('default', {p}bd), {'cast(null as timestamp_ntz)' if e is None else f"timestamp_ntz '{e}'"})" for s, p, e in PRICES)
    return spark.sql(f"SELECT sku_name, named_struct('default', cast(pricing.default AS decimal(10,2))) AS pricing, price_end_time FROM VALUES {values} AS t(sku_name, pricing, price_end_time)")


def history_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, TABLE_NAMES)), (F.col("o_custkey") % len(TABLE_NAMES) + 1).cast("int"))
    key = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("select a, b  from "), name, F.lit(" -- by run\n where prio = '"), F.col("o_orderpriority"), F.lit("' and cust in ("), key, F.lit(", 7,  8) /* x */ and total > 10.5"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("statement_id"), text.alias("statement_text"), F.col("o_orderdate").alias("start_time"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("end_time"),
        F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.floor("o_totalprice")).cast("long").alias("execution_duration_ms"), (F.col("o_custkey") % 5).cast("string").alias("warehouse_id"), F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("FAILED").alias("status"))


def node_timeline_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).cast("string").alias("cluster_id"), F.col("ts").alias("start_time"), F.when(F.col("event_id") % 50 != 0, F.col("ts") + F.expr("interval 10 minutes")).alias("end_time"),
        (F.col("event_type") == "error").alias("driver"), F.least(F.col("value").cast("decimal(18,4)"), F.lit(100).cast("decimal(18,4)")).alias("avg_cpu"), F.col("event_id").alias("node_id"))


def runs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("start_time"), (F.col("ts") + F.expr("interval 1 hour")).alias("end_time"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("result_state"), F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("dbu_total"), F.col("value").cast("string").alias("cost_usd"))


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("user_id % 2 = 1").select(
        F.col("user_id").cast("string").alias("pipeline_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("entity_name"), F.floor("value").cast("long").alias("num_output_rows"), F.when(F.col("event_type") == "error", "flow_failed").otherwise("flow_progress").alias("event_type"))


def node_types_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("node_"), F.col("p_partkey").cast("string")).alias("node_type_id"), F.col("p_size").alias("num_cores"), (F.col("p_size") * 2048).alias("memory_mb"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") / 1000).alias("dbu_per_hour"))


def clusters_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cluster_id"), F.col("s_name").alias("cluster_name"), F.concat(F.lit("node_"), (F.col("s_suppkey") * 3).cast("string")).alias("node_type_id"), F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey") % 4).alias("num_workers"))


def delta_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action a row: seq orders them, path is upserted by add and taken away by remove."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), F.floor("value").cast("long").alias("size"), F.when(F.col("event_type") != "signup", F.floor("value").cast("long") * 2).alias("num_records"))


#: The same views as DuckDB common table expressions.
SQL = {
    "usage": """usage AS (SELECT event_id AS record_id, event_type AS sku_name, CAST(value AS DECIMAL(18,4)) AS usage_quantity, ts AS usage_start_time, ts + INTERVAL 1 HOUR AS usage_end_time,
        CAST(user_id % 20 AS VARCHAR) AS cluster_id, CAST(user_id % 5 AS VARCHAR) AS warehouse_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS job_id, CAST(event_id AS VARCHAR) AS job_run_id,
        CASE WHEN user_id % 2 = 1 THEN CAST(user_id AS VARCHAR) END AS dlt_pipeline_id, CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INT) >= 10 THEN regexp_extract(props, '[0-9]+') END AS team FROM events)""",
    "price": "price(sku_name, price_usd) AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST({p} AS DECIMAL(10,2)))" for s, p, e in PRICES if e is None) + "))",
    "usage_li": """usage_li AS (SELECT l_returnflag AS sku_name, CAST(l_quantity AS DECIMAL(18,4)) AS usage_quantity, l_shipdate AS s, l_shipdate + INTERVAL 1 DAY AS e, CAST(l_suppkey % 5 AS VARCHAR) AS warehouse_id FROM lineitem)""",
    "history": """history AS (SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, 'select a, b  from ' || [""" + ", ".join(f"'{n}'" for n in TABLE_NAMES) + f"""][o_custkey % {len(TABLE_NAMES)} + 1] || ' -- by run' || chr(10) || ' where prio = ''' || o_orderpriority || ''' and cust in (' || o_custkey || ', 7,  8) /* x */ and total > 10.5' AS statement_text,
        o_orderdate AS start_time, o_orderdate + INTERVAL 1 HOUR AS end_time, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS execution_duration_ms, CAST(o_custkey % 5 AS VARCHAR) AS warehouse_id,
        CASE WHEN o_orderstatus = 'F' THEN 'FINISHED' ELSE 'FAILED' END AS status FROM orders)""",
    "node_tl": """node_tl AS (SELECT CAST(user_id % 20 AS VARCHAR) AS cluster_id, ts AS start_time, CASE WHEN event_id % 50 <> 0 THEN ts + INTERVAL 10 MINUTE END AS end_time, event_type = 'error' AS driver, least(CAST(value AS DECIMAL(18,4)), 100) AS avg_cpu, event_id AS node_id FROM events)""",
    "runs": """runs AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id AS VARCHAR) AS run_id, ts AS start_time, ts + INTERVAL 1 HOUR AS end_time, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS result_state,
        CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS dbu_total, CAST(value AS VARCHAR) AS cost_usd FROM events)""",
    "pipe": """pipe AS (SELECT CAST(user_id AS VARCHAR) AS pipeline_id, ts, event_type AS entity_name, CAST(floor(value) AS BIGINT) AS num_output_rows, CASE WHEN event_type = 'error' THEN 'flow_failed' ELSE 'flow_progress' END AS event_type FROM events WHERE user_id % 2 = 1)""",
    "node_types": """node_types AS (SELECT 'node_' || p_partkey AS node_type_id, p_size AS num_cores, p_size * 2048 AS memory_mb, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / 1000 END AS dbu_per_hour FROM part)""",
    "clusters": """clusters AS (SELECT CAST(s_suppkey AS VARCHAR) AS cluster_id, s_name AS cluster_name, 'node_' || (s_suppkey * 3) AS node_type_id, CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey % 4 END AS num_workers FROM supplier)""",
    "delta": """delta AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action, CAST(floor(value) AS BIGINT) AS size, CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS BIGINT) * 2 END AS num_records FROM events)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
