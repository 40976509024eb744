"""The rules and which of them are active."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Code, severity, language, tags, and whether the rule reports anything in parity mode.
RULES = (
    ("BB001", "warning", "notebook", ("notebook", "cost", "governance"), False),
    ("BD001", "warning", "sql", ("delta", "maintenance", "sql"), True),
    ("BD002", "info", "sql", ("delta", "performance", "sql"), False),
    ("BN001", "info", "notebook", ("notebook", "structure"), False),
    ("BN002", "warning", "notebook", ("notebook", "security", "sql"), False),
    ("BN003", "error", "notebook", ("notebook", "structure", "correctness"), False),
    ("BNT-C01", "warning", "python", ("python", "style", "correctness"), True),
    ("BNT-I01", "error", "python", ("python", "import", "style"), True),
    ("BNT-N01", "info", "python", ("python", "style", "naming"), True),
    ("BP001", "info", "python", ("python", "style", "readability"), False),
    ("BP002", "info", "python", ("python", "style", "readability"), True),
    ("BP003", "warning", "python", ("python", "databricks", "magic"), True),
    ("BP004", "warning", "python", ("python", "databricks", "magic"), True),
    ("BP005", "info", "notebook", ("notebook", "style", "structure"), False),
    ("BP006", "info", "notebook", ("notebook", "structure", "maintainability"), False),
    ("BP007", "info", "notebook", ("notebook", "style", "documentation"), False),
    ("BP008", "error", "python", ("pyspark", "memory", "driver-bound"), True),
    ("BP010", "error", "python", ("pyspark", "udf", "performance"), True),
    ("BP011", "error", "python", ("pyspark", "memory", "driver-bound"), True),
    ("BP012", "warning", "python", ("pyspark", "partitioning", "shuffle"), True),
    ("BP013", "warning", "sql", ("sql", "performance", "sort"), False),
    ("BP014", "warning", "python", ("pyspark", "join", "shuffle"), True),
    ("BP015", "info", "python", ("pyspark", "udf", "arrow"), True),
    ("BP016", "warning", "python", ("pyspark", "performance", "full-scan"), True),
    ("BP020", "warning", "python", ("pyspark", "catalyst", "loop"), True),
    ("BP021", "error", "python", ("pyspark", "jdbc", "performance"), True),
    ("BP022", "error", "python", ("pyspark", "sdp", "dlt"), True),
    ("BP023", "warning", "python", ("pyspark", "window", "shuffle"), True),
    ("BP030", "warning", "python", ("pyspark", "memory", "caching"), True),
    ("BP031", "info", "python", ("pyspark", "memory", "caching"), True),
    ("BP032", "warning", "python", ("pyspark", "performance", "caching"), True),
    ("BQ001", "warning", "sql", ("sql", "correctness", "null-safety"), True),
    ("BQ002", "warning", "sql", ("sql", "performance", "dedup"), False),
    ("BQ003", "info", "sql", ("sql", "performance", "aggregation"), True),
    ("BQ004", "error", "sql", ("sql", "performance", "subquery"), True),
    ("SDP001", "warning", "python", ("sdp", "data-quality", "declarative"), True),
    ("SDP002", "warning", "python", ("sdp", "dlt", "incremental"), True),
    ("SDP003", "warning", "python", ("sdp", "streaming", "schema"), True),
    ("SDP004", "warning", "python", ("sdp", "dlt", "performance"), True),
    ("SDP005", "info", "python", ("sdp", "dlt", "documentation"), True),
    ("SQ001", "warning", "sql", ("sql", "performance", "select-star"), True),
    ("SQ002", "warning", "sql", ("sql", "join", "cartesian"), False),
    ("SQ003", "error", "sql", ("sql", "join", "cartesian"), False),
)
SEVERITIES = ("info", "warning", "error")
# Sources that don't parse, dynamic SQL and names bound again are reported under codes of rules, with
# severities of their own.
REPORTED = {"BN001": "error", "BN002": "warning", "BN003": "warning"}


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules; severity is the rule's own, reported the one that its findings have."""
    return spark.createDataFrame([(c, s, lang, list(t), f, REPORTED.get(c, s)) for c, s, lang, t, f in RULES], "code string, severity string, language string, tags array<string>, fires boolean, reported string")


def graded(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings with their severity."""
    return findings.join(F.broadcast(rules.select("code", F.col("reported").alias("severity"))), "code", "left").select(*findings.columns, "severity")  # a fixed list


def resolved(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """patterns (with a column pattern) joined to the codes that each stands for: ALL, else a code, else a tag, else a
    prefix; the first kind that fits alone counts."""
    p = F.col("pattern")
    rank = F.when(p == "ALL", 0).when(p == F.col("code"), 1).when(F.array_contains("tags", p), 2).when(F.col("code").startswith(p), 3)
    fits = patterns.crossJoin(F.broadcast(rules.select("code", "tags"))).withColumn("_rank", rank).where("_rank IS NOT NULL")  # rules are a fixed list
    best = Window.partitionBy(*patterns.columns)
    return fits.withColumn("_best", F.min("_rank").over(best)).where("_rank = _best").select(*patterns.columns, "code").distinct()


def active_rules(rules: DataFrame, select=("ALL",), extend_select=(), ignore=(), extend_ignore=()) -> DataFrame:
    """code: selected and not ignored."""
    spark = rules.sparkSession
    of = lambda names: resolved(spark.createDataFrame([(n,) for n in names], "pattern string"), rules).select("code").distinct()
    return of([*select, *extend_select]).join(of([*ignore, *extend_ignore]), "code", "left_anti")


def glob_regex(glob: str) -> str:
    """A regular expression for whole paths, or their ends after a slash, that fit a glob of *, ? and [...]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "/_-" or ord(c) > 127 else "\\" + c)
        i += 1
    return f"(?s)^(?:.*/)?{out}$"


def ignored_by_file(findings: DataFrame, rules: DataFrame, ignores: dict[str, tuple[str, ...]]) -> DataFrame:
    """findings without those that a glob's patterns turn off for the paths that fit it."""
    for glob, names in ignores.items():
        codes = [r["code"] for r in resolved(rules.sparkSession.createDataFrame([(n,) for n in names], "pattern string"), rules).select("code").distinct().collect()]  # of a fixed list
        findings = findings.where(~(F.col("path").rlike(glob_regex(glob)) & F.col("code").isin(*codes)))
    return findings


def at_least(findings: DataFrame, rules: DataFrame, severity: str) -> DataFrame:
    """Findings of that severity or a worse one."""
    kept = rules.where(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("reported")) > SEVERITIES.index(severity)).select("code")
    return findings.join(kept, "code", "left_semi")


def suppressed(findings: DataFrame, lines: DataFrame, rules: DataFrame, directive: str = "ledger") -> DataFrame:
    """Findings that comments turn off: ``# ledger: ignore-file[...]`` for the whole source, ``# ledger: ignore[...]``
    for its line and, standing alone, for the next; without brackets, every rule."""

    def named(kind: str) -> DataFrame:
        whole = rf"(?i)#\s*{directive}:\s*{kind}"
        listed = F.regexp_extract("line", rf"{whole}\[([^\]]*)\]", 1)
        names = F.when(F.col("line").rlike(rf"{whole}\["), listed).otherwise("")
        names = F.when(names == "", "ALL").otherwise(names)
        each = lines.where(F.col("line").rlike(whole)).select("path", "line_no", F.trim("line").startswith("#").alias("alone"), F.explode(F.split(names, ",")).alias("pattern")).withColumn("pattern", F.trim("pattern")).where("pattern <> ''")
        return resolved(each, rules)

    files = named("ignore-file").select("path", "code").distinct()
    at = named("ignore")
    by_line = at.select("path", "code", F.explode(F.when(F.col("alone"), F.array("line_no", F.col("line_no") + 1)).otherwise(F.array("line_no"))).alias("line_no")).distinct()
    in_file = findings.join(files, ["path", "code"], "left_semi")
    rest = findings.join(files, ["path", "code"], "left_anti")
    return in_file.unionByName(rest.join(by_line, ["path", "code", "line_no"], "left_semi"))
