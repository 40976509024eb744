"""The registered queries of cost analytics and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fingerprint import fingerprint, normalized
from .operators import attribution, costs, lookups
from .sources import adapters as A
from .sources.adapters import with_views

AS_OF = "2024-01-31 00:00:00"
HISTORY_AS_OF = "2002-01-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    """Enters a function under its name, with its DuckDB text."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return enter


def r(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


COST = "usage_quantity * coalesce(price_usd, CAST(0.55 AS DECIMAL(10,2)))"

_TAGS = f"""SELECT coalesce(team, '__untagged__') AS tag_value, CAST(sum({COST}) AS DOUBLE) AS total_cost_usd
    FROM usage LEFT JOIN price USING (sku_name) WHERE usage_start_time >= TIMESTAMP '2024-01-01' GROUP BY 1 HAVING coalesce(team, '__untagged__') <> ''"""
_IDLE = f"""SELECT n.cluster_id, {r('cpu', 2)} AS avg_cpu_pct, {r('hours', 2)} AS running_hours, {r('total', 4)} AS total_cost_usd, {r('total * (1.0::DOUBLE - cpu / 100.0::DOUBLE)', 4)} AS wasted_cost_usd,
        'Enable auto-termination (idle > 10 min) or terminate manually.' AS recommendation
    FROM (SELECT cluster_id, CAST(sum(avg_cpu) AS DOUBLE) / count(avg_cpu) AS cpu, CAST(sum(date_diff('second', date_trunc('second', start_time), date_trunc('second', coalesce(end_time, TIMESTAMP '2024-01-31') - (start_time - date_trunc('second', start_time))))) AS DOUBLE) / 3600.0::DOUBLE AS hours
          FROM node_tl WHERE start_time >= TIMESTAMP '2024-01-24' AND NOT driver GROUP BY 1) n
    JOIN (SELECT cluster_id, CAST(sum({COST}) AS DOUBLE) AS total FROM usage LEFT JOIN price USING (sku_name) WHERE usage_start_time >= TIMESTAMP '2024-01-24' AND sku_name = 'click' GROUP BY 1) c USING (cluster_id)
    WHERE cpu < 45.0"""
_DRIFT = f"""SELECT resource_id, {r('median_cost', 4)} AS median_cost, {r('recent_avg', 4)} AS recent_avg, {r('(recent_avg - median_cost) / median_cost', 4)} AS drift_ratio
    FROM (SELECT resource_id, CAST(quantile_disc(cost, 0.5) FILTER (WHERE day < DATE '2024-01-24') AS DOUBLE) AS median_cost,
                 CAST(sum(cost) FILTER (WHERE day >= DATE '2024-01-24') AS DOUBLE) / count(cost) FILTER (WHERE day >= DATE '2024-01-24') AS recent_avg
          FROM (SELECT CASE WHEN job_id IS NOT NULL THEN 'job:' || job_id ELSE 'pipeline:' || dlt_pipeline_id END AS resource_id, CAST(usage_start_time AS DATE) AS day, sum({COST}) AS cost
                FROM usage LEFT JOIN price USING (sku_name) WHERE usage_start_time >= TIMESTAMP '2024-01-01' GROUP BY 1, 2) GROUP BY 1)
    WHERE median_cost > 0 AND recent_avg IS NOT NULL AND abs((recent_avg - median_cost) / median_cost) >= 0.25"""


def _usage(spark, d):
    return A.usage_from_events(spark, d)


@registered(f"{with_views('usage', 'price')} {_TAGS}")
def tag_cost(spark, sf_dir):
    return costs.tag_costs(_usage(spark, sf_dir), A.list_prices(spark), "team", AS_OF)


@registered(f"{with_views('usage', 'price', 'node_tl')} {_IDLE}")
def idle_clusters(spark, sf_dir):
    return costs.idle_clusters(A.node_timeline_from_events(spark, sf_dir), _usage(spark, sf_dir), A.list_prices(spark), AS_OF, threshold=0.45, sku="click")


@registered(f"{with_views('usage', 'price')} {_DRIFT}")
def cost_drift(spark, sf_dir):
    return costs.cost_drift(_usage(spark, sf_dir), A.list_prices(spark), AS_OF)


@registered(f"""{with_views('usage', 'price', 'runs')}, newest AS (SELECT * FROM runs WHERE start_time >= TIMESTAMP '2024-01-01' ORDER BY start_time DESC, job_id, run_id LIMIT 200),
    total AS (SELECT n.job_id, run_id, start_time, end_time, result_state, sum({COST}) AS total FROM newest n LEFT JOIN usage u ON u.job_id = n.job_id AND u.job_run_id = n.run_id LEFT JOIN price USING (sku_name) GROUP BY ALL),
    med AS (SELECT job_id, CAST(quantile_disc(total, 0.5) AS DOUBLE) AS median FROM total GROUP BY 1),
    out AS (SELECT t.job_id, run_id, start_time, end_time, result_state, coalesce({r('total', 4)}, 0) AS total_cost_usd, coalesce({r('(CAST(total AS DOUBLE) - median) / nullif(median, 0)', 4)}, 0) AS pct FROM total t JOIN med USING (job_id))
    SELECT job_id, run_id, start_time, end_time, result_state, total_cost_usd, pct AS pct_change_vs_median,
           CASE WHEN pct > 0.20 THEN 'spike (+' || CAST(round_even(CAST(pct * 100 AS DECIMAL(28,6)), 0) AS BIGINT) || '%)' WHEN pct < -0.20 THEN 'drop (' || CAST(round_even(CAST(pct * 100 AS DECIMAL(28,6)), 0) AS BIGINT) || '%)' ELSE '' END AS annotation FROM out""")
def job_report(spark, sf_dir):
    return costs.job_report(A.runs_from_events(spark, sf_dir), _usage(spark, sf_dir), A.list_prices(spark), AS_OF, limit=200)


@registered(f"""{with_views('usage', 'price', 'pipe')}, daily AS (SELECT dlt_pipeline_id AS pipeline_id, CAST(usage_start_time AS DATE) AS update_date, sum({COST}) AS cost FROM usage LEFT JOIN price USING (sku_name)
        WHERE usage_start_time >= TIMESTAMP '2024-01-01' AND starts_with(sku_name, 'pur') AND dlt_pipeline_id IS NOT NULL GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 60),
    tables AS (SELECT pipeline_id, CAST(ts AS DATE) AS update_date, entity_name, sum(num_output_rows) AS n FROM pipe WHERE event_type = 'flow_progress' AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2, 3),
    top AS (SELECT pipeline_id, update_date, entity_name AS dominant_table FROM tables QUALIFY row_number() OVER (PARTITION BY pipeline_id, update_date ORDER BY n DESC, entity_name DESC) = 1)
    SELECT pipeline_id, CAST(update_date AS VARCHAR) AS update_date, {r('cost', 4)} AS total_cost_usd, dominant_table FROM daily LEFT JOIN top USING (pipeline_id, update_date)""")
def pipeline_report(spark, sf_dir):
    return costs.pipeline_report(_usage(spark, sf_dir), A.list_prices(spark), A.pipeline_events(spark, sf_dir), AS_OF, limit=60, sku_prefix="pur").withColumn("update_date", F.col("update_date").cast("string"))


@registered(f"""{with_views('usage', 'price', 'node_tl')}, t AS ({_TAGS}) SELECT 'tag' AS monitor, tag_value AS key, total_cost_usd AS value FROM t
    UNION ALL SELECT 'idle', cluster_id, wasted_cost_usd FROM ({_IDLE}) UNION ALL SELECT 'drift', resource_id, drift_ratio FROM ({_DRIFT})
    UNION ALL SELECT 'total', 'usd', CAST(coalesce(sum(CAST(total_cost_usd AS DECIMAL(28,6))), 0) AS DOUBLE) FROM t""")
def watch_report(spark, sf_dir):
    return costs.watch_report(tag_cost(spark, sf_dir), idle_clusters(spark, sf_dir), cost_drift(spark, sf_dir))


@registered(f"{with_views('usage')} SELECT record_id, sku_name, CAST(usage_quantity AS DOUBLE) AS usage_quantity, usage_start_time, usage_end_time, cluster_id, warehouse_id, job_id FROM usage WHERE usage_start_time >= TIMESTAMP '2024-01-24'")
def usage_window(spark, sf_dir):
    return lookups.usage_window(_usage(spark, sf_dir), AS_OF, 7)


@registered(f"{with_views('price')} SELECT sku_name, CAST(max(price_usd) AS DOUBLE) AS price_usd FROM price WHERE sku_name IN ('click', 'view', 'signup') GROUP BY 1")
def live_prices(spark, sf_dir):
    return lookups.live_prices(A.list_prices(spark), ["click", "view", "signup"])


@registered(f"{with_views('node_types')} SELECT node_type_id, dbu_per_hour FROM node_types WHERE dbu_per_hour IS NOT NULL")
def node_types(spark, sf_dir):
    return lookups.node_type_rates(A.node_types_from_part(spark, sf_dir))


@registered(f"{with_views('node_types', 'clusters')} SELECT cluster_id, cluster_name, node_type_id, CAST(coalesce(nullif(num_workers, 0), 1) AS INT) AS num_workers, coalesce(dbu_per_hour, 0.0) AS dbu_per_hour FROM clusters LEFT JOIN node_types USING (node_type_id)")
def cluster_config(spark, sf_dir):
    return lookups.cluster_configs(A.clusters_from_supplier(spark, sf_dir), A.node_types_from_part(spark, sf_dir))


@registered(f"{with_views('node_tl')} SELECT cluster_id, node_id, start_time, end_time, driver FROM node_tl WHERE cluster_id = '3' AND start_time >= TIMESTAMP '2024-01-10' AND end_time <= TIMESTAMP '2024-01-20'")
def node_timeline(spark, sf_dir):
    return lookups.node_timeline(A.node_timeline_from_events(spark, sf_dir), "3", "2024-01-10", "2024-01-20")


@registered(f"{with_views('history')} SELECT statement_id, statement_text, start_time, end_time, execution_duration_ms, warehouse_id, status FROM history WHERE warehouse_id = '2' AND start_time >= TIMESTAMP '2002-01-01' - INTERVAL 3650 DAY ORDER BY start_time DESC, statement_id LIMIT 10000")
def recent_history(spark, sf_dir):
    return lookups.query_history(A.history_from_orders(spark, sf_dir), "2", HISTORY_AS_OF, 3650)


@registered(f"{with_views('history')} SELECT statement_id, statement_text, start_time, end_time, execution_duration_ms, warehouse_id, status FROM history ORDER BY start_time DESC, statement_id LIMIT 100")
def recent_queries(spark, sf_dir):
    return lookups.recent_queries(A.history_from_orders(spark, sf_dir))


# RE2 has no look-behind; the texts keep numbers away from identifiers
_NORM = r"regexp_replace(regexp_replace(regexp_replace(upper(trim(regexp_replace(regexp_replace(regexp_replace(statement_text, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))), '''[^'']*''', '?', 'g'), '[0-9]+(\.[0-9]+)?', '?', 'g'), 'IN\s*\(\s*\?(?:\s*,\s*\?)*\s*\)', 'IN (?)', 'g')"


@registered(f"{with_views('history')} SELECT statement_id, {_NORM} AS normalized, sha256({_NORM}) AS query_fingerprint FROM history")
def fingerprints(spark, sf_dir):
    return A.history_from_orders(spark, sf_dir).select("statement_id", normalized(F.col("statement_text")).alias("normalized"), fingerprint(F.col("statement_text")).alias("query_fingerprint"))


_WANTED = "SELECT A, B FROM DELTA WHERE PRIO = ? AND CUST IN (?) AND TOTAL > ?"


@registered(f"{with_views('history')}, newest AS (SELECT * FROM history WHERE status = 'FINISHED' ORDER BY start_time DESC, statement_id LIMIT 1000) SELECT statement_id, statement_text, start_time, end_time, execution_duration_ms, warehouse_id, status, sha256({_NORM}) AS query_fingerprint FROM newest WHERE sha256({_NORM}) = sha256('{_WANTED}') ORDER BY start_time DESC, statement_id LIMIT 10")
def similar_queries(spark, sf_dir):
    return attribution.similar_queries(A.history_from_orders(spark, sf_dir), F.sha2(F.lit(_WANTED), 256))


@registered(f"""{with_views('usage_li', 'price', 'history')}, p AS (SELECT sha256({_NORM}) AS fp, usage_quantity AS q, {COST} AS c, execution_duration_ms AS ms FROM usage_li LEFT JOIN price USING (sku_name) JOIN history h ON h.warehouse_id = usage_li.warehouse_id AND s <= end_time AND start_time <= e)
    SELECT fp AS query_fingerprint, CAST(sum(q) AS DOUBLE) AS total_dbu, CAST(sum(c) AS DOUBLE) AS total_cost_usd, count(*) AS execution_count, {r('coalesce(CAST(sum(nullif(ms, 0)) AS DOUBLE) / count(nullif(ms, 0)), 0)', 4)} AS avg_duration_ms FROM p GROUP BY 1""")
def query_cost_attribution(spark, sf_dir):
    return attribution.query_costs(A.usage_from_lineitem(spark, sf_dir), A.history_from_orders(spark, sf_dir), A.list_prices(spark))


@registered(f"""{with_views('usage_li', 'history')}, m AS (SELECT DISTINCT sha256({_NORM}) AS query_fingerprint, statement_id, start_time, execution_duration_ms FROM history h JOIN usage_li u ON h.warehouse_id = u.warehouse_id AND s <= end_time AND start_time <= e)
    SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_fingerprint ORDER BY start_time DESC, statement_id) <= 10""")
def query_samples(spark, sf_dir):
    return attribution.query_samples(A.usage_from_lineitem(spark, sf_dir), A.history_from_orders(spark, sf_dir))


@registered(f"""{with_views('usage_li', 'price', 'history')}, newest AS (SELECT * FROM history WHERE status = 'FINISHED' ORDER BY start_time DESC, statement_id LIMIT 10000), lk AS (SELECT * FROM newest WHERE sha256({_NORM}) = sha256('{_WANTED}') ORDER BY start_time DESC, statement_id LIMIT 100),
    cost AS (SELECT sum(usage_quantity) AS q, sum({COST}) AS c FROM lk h JOIN usage_li u ON h.warehouse_id = u.warehouse_id AND s <= end_time AND start_time <= e LEFT JOIN price USING (sku_name))
    SELECT sha256('{_WANTED}') AS query_fingerprint, (SELECT count(*) FROM lk) AS execution_count, (SELECT coalesce({r('avg(nullif(execution_duration_ms, 0))', 4)}, 0) FROM lk) AS avg_duration_ms, CAST(q AS DOUBLE) AS total_dbu, CAST(c AS DOUBLE) AS total_cost_usd FROM cost WHERE q <> 0""")
def historical_cost(spark, sf_dir):
    return attribution.historical_cost(A.usage_from_lineitem(spark, sf_dir), A.history_from_orders(spark, sf_dir), A.list_prices(spark), F.sha2(F.lit(_WANTED), 256)).drop("samples")


@registered(f"{with_views('history')}, newest AS (SELECT * FROM history WHERE status = 'FINISHED' AND warehouse_id = '2' ORDER BY start_time DESC, statement_id LIMIT 2000) SELECT statement_id, start_time, execution_duration_ms, warehouse_id, sha256({_NORM}) AS query_fingerprint FROM newest WHERE sha256({_NORM}) = sha256('{_WANTED}') ORDER BY start_time DESC, statement_id LIMIT 20")
def similar_queries_of_warehouse(spark, sf_dir):
    return attribution.similar_queries(A.history_from_orders(spark, sf_dir), F.sha2(F.lit(_WANTED), 256), 20, "2").select("statement_id", "start_time", "execution_duration_ms", "warehouse_id", "query_fingerprint")


_SPAN = "TIMESTAMP '2002-01-01' - INTERVAL 3650 DAY"
_OF_3 = f"usage_3 AS (SELECT * FROM usage_li WHERE warehouse_id = '3' AND s >= {_SPAN}), lk AS (SELECT * FROM (SELECT * FROM history WHERE status = 'FINISHED' AND warehouse_id = '3' ORDER BY start_time DESC, statement_id LIMIT 10000) WHERE sha256({_NORM}) = sha256('{_WANTED}') ORDER BY start_time DESC, statement_id LIMIT 100)"


@registered(f"""{with_views('usage_li', 'price', 'history')}, {_OF_3}, cost AS (SELECT sum(usage_quantity) AS q, sum({COST}) AS c FROM lk h JOIN usage_3 u ON s <= end_time AND start_time <= e LEFT JOIN price USING (sku_name))
    SELECT sha256('{_WANTED}') AS query_fingerprint, (SELECT count(*) FROM lk) AS execution_count, (SELECT coalesce({r('avg(nullif(execution_duration_ms, 0))', 4)}, 0) FROM lk) AS avg_duration_ms, CAST(q AS DOUBLE) AS total_dbu, CAST(c AS DOUBLE) AS total_cost_usd FROM cost WHERE q <> 0""")
def historical_cost_of_warehouse(spark, sf_dir):
    return attribution.historical_cost(A.usage_from_lineitem(spark, sf_dir), A.history_from_orders(spark, sf_dir), A.list_prices(spark), F.sha2(F.lit(_WANTED), 256), warehouse_id="3", as_of=HISTORY_AS_OF, days=3650).drop("samples")


@registered(f"{with_views('usage_li', 'history')}, {_OF_3} SELECT statement_id, start_time, execution_duration_ms AS duration_ms FROM lk WHERE EXISTS (SELECT 1 FROM lk h JOIN usage_3 u ON s <= end_time AND start_time <= e) ORDER BY start_time DESC, statement_id LIMIT 10")
def historical_samples(spark, sf_dir):
    found = attribution.historical_cost(A.usage_from_lineitem(spark, sf_dir), A.history_from_orders(spark, sf_dir), A.list_prices(spark), F.sha2(F.lit(_WANTED), 256), warehouse_id="3", as_of=HISTORY_AS_OF, days=3650)
    return found.select(F.explode("samples").alias("x")).select("x.*")


@registered(f"""{with_views('usage_li', 'price', 'history')}, p AS (SELECT sha256({_NORM}) AS fp, usage_quantity AS q, {COST} AS c, execution_duration_ms AS ms FROM usage_li LEFT JOIN price USING (sku_name) JOIN history h ON h.warehouse_id = usage_li.warehouse_id AND s <= end_time AND start_time <= e WHERE usage_li.warehouse_id = '1' AND s >= {_SPAN} AND start_time >= {_SPAN})
    SELECT fp AS query_fingerprint, CAST(sum(q) AS DOUBLE) AS total_dbu, CAST(sum(c) AS DOUBLE) AS total_cost_usd, count(*) AS execution_count, {r('coalesce(CAST(sum(nullif(ms, 0)) AS DOUBLE) / count(nullif(ms, 0)), 0)', 4)} AS avg_duration_ms FROM p GROUP BY 1""")
def query_costs_of_warehouse(spark, sf_dir):
    usage, history = attribution.within(A.usage_from_lineitem(spark, sf_dir), A.history_from_orders(spark, sf_dir), "1", HISTORY_AS_OF, 3650)
    return attribution.query_costs(usage, history, A.list_prices(spark))


@registered(f"{with_views('runs')} SELECT job_id, run_id, start_time, end_time, TRY_CAST(dbu_total AS DOUBLE) AS dbu_total, TRY_CAST(cost_usd AS DOUBLE) AS cost_usd FROM runs WHERE start_time >= TIMESTAMP '2024-01-01' AND TRY_CAST(dbu_total AS DOUBLE) IS NOT NULL AND TRY_CAST(cost_usd AS DOUBLE) IS NOT NULL")
def run_costs(spark, sf_dir):
    return attribution.run_costs(A.runs_from_events(spark, sf_dir), AS_OF)
