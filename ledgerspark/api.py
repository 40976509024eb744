"""check and watch: the two calls most users need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import costs
from .plans import lint, rules
from .sources import corpus
from .sources.registry import TableRegistry


def check_sources(sources: DataFrame, settings: Settings = Settings(), strict: bool = False, only: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """path, code, line_no, severity of the active rules' findings in sources that no comment suppresses."""
    table = rules.rules_table(sources.sparkSession)
    active = rules.active_rules(table, settings.select, settings.extend_select, settings.ignore, settings.extend_ignore)
    found = lint.findings(sources, strict).join(F.broadcast(active), "code", "left_semi")  # a fixed list
    if only:
        found = found.where(F.col("code").isin(*only))
    if skip:
        found = found.where(~F.col("code").isin(*skip))
    found = rules.ignored_by_file(found, table, settings.per_file_ignores)
    off = rules.suppressed(found, lint.source_lines(sources), table, settings.directive)
    kept = found.join(off.distinct(), ["path", "code", "line_no"], "left_anti")
    return rules.graded(kept, table).select("path", "code", "line_no", "severity")


def check(spark: SparkSession, target: str, settings: Settings = Settings(), **options) -> DataFrame:
    """check_sources of a folder's files or, where target holds white space, of it as SQL text."""
    if any(c.isspace() for c in target):
        return check_sources(spark.createDataFrame([("<sql>", "sql", target)], "path string, language string, content string"), settings, **options)
    return check_sources(corpus.source_files(spark, target, exclude=settings.exclude), settings, **options)


def watch(spark: SparkSession, as_of: str, settings: Settings = Settings(), registry: TableRegistry | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Reports by monitor, and the status of each: ok, skipped or what went wrong; one failure leaves the others."""
    registry = registry or TableRegistry()
    t = lambda name: registry.scan(spark, name)
    jobs = {
        "tag": lambda: costs.tag_costs(t("billing_usage"), t("billing_list_prices"), settings.tag_key, as_of, settings.days),
        "idle": lambda: costs.idle_clusters(t("compute_node_timeline"), t("billing_usage"), t("billing_list_prices"), as_of, min(settings.days, 7), settings.idle_threshold),
        "drift": lambda: costs.cost_drift(t("billing_usage"), t("billing_list_prices"), as_of, settings.days, settings.drift_threshold),
    }
    out, status = {}, {}
    for name, job in jobs.items():
        if name == "tag" and not settings.tag_key:
            status[name] = "skipped"
            continue
        try:
            out[name], status[name] = job(), "ok"
        except Exception as e:  # the other monitors still report
            status[name] = f"failed: {e}"
    return out, status
