"""Names of the system tables.  A name may be overridden per field, or by LEDGERSPARK_TABLE_<FIELD> in the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class TableRegistry:
    billing_usage: str = "system.billing.usage"
    billing_list_prices: str = "system.billing.list_prices"
    query_history: str = "system.query.history"
    compute_node_types: str = "system.compute.node_types"
    compute_clusters: str = "system.compute.clusters"
    compute_node_timeline: str = "system.compute.node_timeline"
    lakeflow_job_run_timeline: str = "system.lakeflow.job_run_timeline"
    lakeflow_jobs: str = "system.lakeflow.jobs"
    predictive_optimization: str = "system.storage.predictive_optimization_operations_history"
    lakeflow_pipeline_event_log: str = "system.lakeflow.pipeline_event_log"
    #: Per field: {our column: column of the overriding table}.
    column_overrides: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "LEDGERSPARK_TABLE_") -> TableRegistry:
        names = [f.name for f in fields(cls) if f.name != "column_overrides"]
        return cls(**{n: os.environ[prefix + n.upper()] for n in names if prefix + n.upper() in os.environ})

    def scan(self, spark: SparkSession, name: str) -> DataFrame:
        """The table of that field, overridden columns renamed to ours; Catalyst prunes the rest."""
        df = spark.table(getattr(self, name))
        return df.withColumnsRenamed({theirs: ours for ours, theirs in self.column_overrides.get(name, {}).items()})

    def format_sql(self, sql: str) -> str:
        """sql with every default name replaced by the registered one."""
        for f in fields(self):
            if f.name != "column_overrides":
                sql = sql.replace(f.default, getattr(self, f.name))
        return sql


def access_report(spark: SparkSession, registry: TableRegistry) -> DataFrame:
    """table_name, status: OK, NO ACCESS (absent or not allowed) or ERROR; one probing row is read from each table."""
    rows = []
    for f in fields(registry):
        if f.name == "column_overrides":
            continue
        name = getattr(registry, f.name)
        try:
            spark.table(name).select(F.lit(1)).limit(1).collect()
            status = "OK"
        except Exception as e:  # the state of every table is the result
            text = str(e).upper()
            status = "NO ACCESS" if any(x in text for x in ("NOT_FOUND", "PERMISSION", "ACCESS", "CANNOT BE FOUND", "REQUIRES_SINGLE_PART")) else "ERROR"
        rows.append((name, status))
    return spark.createDataFrame(rows, "table_name string, status string")
