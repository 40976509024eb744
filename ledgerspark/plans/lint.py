"""Findings of the rules over a corpus of sources (path, language, content).

Rules about lines are column expressions over exploded lines; rules about syntax parse a source once in a Python worker
and report every rule from that tree.  All give rows (path, code, line_no).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import semantics

FINDING = "path string, code string, line_no int"
SDP_OPERATIONS = ("write", "collect", "show", "display")
ACTIONS = ("collect", "count", "show", "take", "first", "write")


def source_lines(sources: DataFrame) -> DataFrame:
    """path, language, line_no (from 1), line (without its end)."""
    return sources.select("path", "language", F.posexplode(F.split("content", "\r?\n", -1)).alias("_at", "line")).select("path", "language", (F.col("_at") + 1).alias("line_no"), "line")


def _any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def line_findings(lines: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Rules that look at one line: those wanted, or all."""
    t = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    up = F.upper(t)
    parts = F.split(t, "=", -1)
    python = {
        "BP002": F.octet_length("line") > 120,
        "BP003": t.startswith("# MAGIC"),
        "BP004": F.regexp_extract(t, r"^# MAGIC\s*(\S*)", 1).isin("run", "sql", "md"),
        "BNT-I01": _any(t, "from pyspark.sql.functions import *"),
        "BNT-C01": _any(t, "df['", 'df["') & ~_any(t, "F.col", "col("),
        "BNT-N01": (F.size(parts) == 2) & F.trim(F.get(parts, F.lit(0))).rlike("^df[0-9]*$"),
    }
    sql = {"BD001": _any(up, "VACUUM"), "BQ003": _any(up, "COUNT(DISTINCT"), "BQ004": _any(up, "NOT IN") & _any(up, "SELECT")}
    if wanted:
        python, sql = ({k: v for k, v in x.items() if k in wanted} for x in (python, sql))
        codes = [F.when((F.col("language") == language) & c, code) for language, x in (("python", python), ("sql", sql)) for code, c in x.items()]
        if len(codes) == 1:
            return lines.select("path", codes[0].alias("code"), "line_no").where("code IS NOT NULL")
        return lines.select("path", F.explode(F.array_compact(F.array(*codes))).alias("code"), "line_no")
    codes = F.concat(
        F.when(F.col("language") == "python", F.array(*[F.when(c, code) for code, c in python.items()])).otherwise(F.array().cast("array<string>")),
        F.when(F.col("language") == "sql", F.array(*[F.when(c, code) for code, c in sql.items()])).otherwise(F.array().cast("array<string>")),
        F.when((F.col("language") == "python") & _any(t, "sdp."), F.array(*[F.when(_any(t, f".{op}("), "BP022") for op in SDP_OPERATIONS])).otherwise(F.array().cast("array<string>")))
    return lines.select("path", F.explode(F.array_compact(codes)).alias("code"), "line_no")


def loop_findings(lines: DataFrame) -> DataFrame:
    """BP020: withColumn between a for line and a line that is a lone parenthesis."""
    t = F.trim("line")
    opens = t.startswith("for ") & F.contains(t, F.lit(" in "))
    adds = t.startswith("withColumn") | F.contains(t, F.lit(".withColumn("))
    state = F.when(opens, True).when((t == ")") | t.startswith("for "), False)
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.where("language = 'python'").withColumns({"_adds": adds & ~opens, "_in": F.last(F.when(~adds | opens, state), ignorenulls=True).over(before)})
    return marked.where("_adds AND _in").select("path", F.lit("BP020").alias("code"), "line_no")


def text_findings(sources: DataFrame, strict: bool = False) -> DataFrame:
    """Rules over whole sources.  strict adds those that parity mode keeps silent."""
    c = F.col("content")
    line_of = lambda regex: F.length(F.substring(c, F.lit(1), F.regexp_instr(c, F.lit(regex)))) - F.length(F.replace(F.substring(c, F.lit(1), F.regexp_instr(c, F.lit(regex))), F.lit("\n"), F.lit(""))) + 1
    python = {
        "BP021": (_any(c, "jdbc") & ~_any(c, "partitionColumn", "numPartitions", "lowerBound", "upperBound") & _any(c, ".read(", "spark.read"), F.lit(1)),
        "BP023": (_any(c, "Window.orderBy", "Window.order_by") & ~_any(c, ".partitionBy(", ".partition_by("), F.lit(1)),
    }
    star, not_in = r"(?i)\bselect\s+\*", r"(?i)\bnot\s+in\s*\(\s*select\b"
    sql = {"SQ001": (c.rlike(star) & ~c.rlike(r"(?is)\bfrom\b.*\blimit\b"), line_of(star)), "BQ001": (c.rlike(not_in), line_of(not_in))}
    if strict:
        union, cross, sort = r"(?i)\bunion\b(?!\s+all\b)", r"(?i)\bcross\s+join\b", r"(?i)\border\s+by\b"
        sql |= {"BQ002": (c.rlike(union), line_of(union)), "SQ003": (c.rlike(cross), line_of(cross)), "BP013": (c.rlike(sort) & ~c.rlike(r"(?is)\border\s+by\b.*\blimit\b"), line_of(sort))}
    of = lambda language, rules: F.when(F.col("language") == language, F.array(*[F.when(hit, F.struct(F.lit(code).alias("code"), line.cast("int").alias("line_no"))) for code, (hit, line) in rules.items()]))
    return sources.select("path", F.explode(F.array_compact(F.coalesce(of("python", python), of("sql", sql)))).alias("x")).select("path", "x.code", "x.line_no")


def syntax_codes(content: str) -> list[tuple[str, int]]:
    """(code, line) of one Python source: the first match of each rule, unless something excludes the rule anywhere in
    the source.  A source that doesn't parse gives BN001 at the place."""
    import ast

    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("BN001", getattr(e, "lineno", None) or 1)]
    found: dict[str, list[tuple[int, int]]] = {}
    excluded: set[str] = set()

    def hit(code: str, node) -> None:
        found.setdefault(code, []).append((node.lineno, node.col_offset))

    def attribute(node) -> str:
        return node.attr if isinstance(node, ast.Attribute) else ""

    for node in ast.walk(tree):
        for deco in getattr(node, "decorator_list", []):
            if isinstance(deco, ast.Attribute) and isinstance(deco.value, ast.Name) and deco.value.id == "udf":
                hit("BP010", deco)
            if isinstance(deco, ast.Call) and attribute(deco.func) == "table" and isinstance(deco.func.value, ast.Name) and deco.func.value.id == "dlt":
                for code in ("SDP001", "SDP002", "SDP004", "SDP005"):
                    hit(code, deco)
        if attribute(node) == "readStream":
            hit("SDP003", node)
        if not isinstance(node, ast.Call):
            continue
        name, on = attribute(node.func), getattr(node.func, "value", None)
        after = attribute(on.func) if isinstance(on, ast.Call) else ""
        if name == "collect":
            hit("BP008", node)
            if after == "limit":
                excluded.add("BP008")
        elif name in ("toPandas", "to_pandas", "topandas"):
            hit("BP011", node)
            if after in ("limit", "take"):
                excluded.add("BP011")
        elif name == "repartition" and any(isinstance(a, ast.Constant) and type(a.value) is int and a.value == 1 for a in node.args):
            hit("BP012", node)
        elif name == "crossJoin":
            hit("BP014", node)
        elif name == "pandas_udf" and isinstance(on, ast.Name) and on.id == "f":
            hit("BP015", node)
        elif name == "count" and not node.args:
            hit("BP016", node)
            if isinstance(on, ast.Call):
                excluded.add("BP016")
        elif name == "register" and attribute(on) == "udf":
            hit("BP010", node)
        if isinstance(node.func, ast.Name) and node.func.id == "udf":
            hit("BP010", node)
    return sorted((code, min(at)[0]) for code, at in found.items() if code not in excluded)


def syntax_findings(sources: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = [(p, code, line) for p, c in zip(pdf["path"], pdf["content"], strict=True) for code, line in syntax_codes(c)]
            yield pd.DataFrame(rows, columns=["path", "code", "line_no"])

    return sources.where("language = 'python'").select("path", "content").mapInPandas(run, FINDING)


def cache_findings(lines: DataFrame) -> DataFrame:
    """BP030 (cached, never unpersisted), BP031 (cached, one action line), BP032 (several action lines, not cached)."""
    t = F.trim("line")
    action = _any(t, *[f".{a}(" for a in ACTIONS])
    var = F.trim(F.get(F.split(t, "=", -1), F.lit(0)))
    own = F.when(F.contains(t, F.lit("=")) & var.rlike(r"^\p{L}"), F.when(F.contains(t, F.lit(".cache()")), "cache").when(F.contains(t, F.lit(".unpersist()")), "unpersist").when(action, "action"))
    python = lines.where("language = 'python'").select("path", "line_no", t.alias("t"), own.alias("op"), var.alias("var"), action.alias("action"))
    direct = python.where("op IS NOT NULL").select("path", "var", "op", "line_no")
    known = direct.where("op <> 'unpersist'").groupBy("path", "var").agg(F.min("line_no").alias("since"))
    uses = F.when(F.contains("t", F.concat("var", F.lit(".cache()"))), "cache").when(F.contains("t", F.concat("var", F.lit(".unpersist()"))), "unpersist").when(F.col("action") & F.contains("t", F.concat("var", F.lit("."))), "action")
    # variables times lines of one source, never across sources
    later = known.join(python.select("path", "line_no", "t", "action").where(_any(F.col("t"), ".cache()", ".unpersist()") | F.col("action")), "path").where("line_no >= since").select("path", "var", uses.alias("op"), "line_no").where("op IS NOT NULL")
    each = direct.unionByName(later).distinct()
    of = lambda op: F.when(F.col("op") == op, F.col("line_no"))
    state = each.groupBy("path", "var").agg(F.min(of("cache")).alias("cached"), F.count(of("unpersist")).alias("freed"), F.count(of("action")).alias("actions"), F.collect_list(of("action")).alias("action_lines"))
    row = lambda code, line: F.struct(F.lit(code).alias("code"), line.cast("int").alias("line_no"))
    rows = F.concat(
        F.when(F.col("cached").isNotNull() & (F.col("freed") == 0), F.array(row("BP030", F.col("cached")))).otherwise(F.array()),
        F.when(F.col("cached").isNotNull() & (F.col("actions") == 1), F.array(row("BP031", F.col("cached")))).otherwise(F.array()),
        F.when(F.col("cached").isNull() & (F.col("actions") >= 2), F.transform("action_lines", lambda x: row("BP032", x))).otherwise(F.array()))
    return state.select("path", F.explode(rows).alias("x")).select("path", "x.code", "x.line_no")


def findings(sources: DataFrame, strict: bool = False) -> DataFrame:
    """All rules over all sources, a multiset of path, code, line_no.  strict adds the rules that are silent in parity
    mode: BQ002, SQ002, SQ003, BP006, BP007, BP013, and BN002 for dynamic SQL.  BB001, BD002, BP001 and BP005 have no
    definition."""
    lines = source_lines(sources)
    out = line_findings(lines)
    shadows = semantics.shadowed(semantics.bindings(sources)).select("path", F.lit("BN003").alias("code"), "line_no")
    if strict:
        dynamic = semantics.sql_fragments(sources).where("dynamic").select("path", F.lit("BN002").alias("code"), F.col("start_line").alias("line_no"))
        out = out.unionByName(semantics.notebook_findings(sources)).unionByName(dynamic)
    for more in (loop_findings(lines), text_findings(sources, strict), syntax_findings(sources), cache_findings(lines), semantics.sql_plan_findings(sources, strict), shadows):
        out = out.unionByName(more)
    return out
