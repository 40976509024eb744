"""Names, embedded SQL and statements of a corpus of sources (path, language, content)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an assigned expression begins with, and its class.
RIGHT_SIDES = (("sdp.read", "sdp_read"), ("dlt.read_", "sdp_read"), ("dp.read", "dp_read"), ("spark.readStream", "spark_read_stream"), ("spark.read", "spark_read"), ("udf.", "udf"))
CHAIN = {"has_limit": ("limit", "take", "head"), "has_select": ("select", "selectExpr"), "has_filter": ("filter", "where"), "is_streaming": ("readStream", "writeStream")}


def right_side(text: str) -> str:
    return next((kind for start, kind in RIGHT_SIDES if text.startswith(start)), "udf" if text.endswith("_udf") else "unknown")


def _parsed(content: str | None):
    import ast

    try:
        return ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def bindings(sources: DataFrame) -> DataFrame:
    """path, seq, name, line_no, rhs, has_limit, has_select, has_filter, is_streaming: every assignment to a plain name
    in the order of the source, whatever its scope.  A source that doesn't parse has none."""

    def run(batches: Iterator) -> Iterator:
        import ast

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                tree = _parsed(content)
                nodes = [n for n in ast.walk(tree) if isinstance(n, ast.Assign | ast.AnnAssign)] if tree else []
                seq = 0
                for node in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
                    names = [t for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
                    inner = list(ast.walk(node.value)) if node.value is not None else []
                    calls = {n.attr for n in inner if isinstance(n, ast.Attribute)}
                    flags = [bool(calls & set(words)) for words in CHAIN.values()]
                    for t in names:
                        rows.append((path, seq, t.id, t.lineno, right_side(ast.unparse(node.value)) if node.value is not None else "unknown", *flags))
                        seq += 1
            yield pd.DataFrame(rows, columns=["path", "seq", "name", "line_no", "rhs", *CHAIN])

    return sources.where("language = 'python'").select("path", "content").mapInPandas(run, "path string, seq int, name string, line_no int, rhs string, " + ", ".join(f"{c} boolean" for c in CHAIN))


def shadowed(names: DataFrame) -> DataFrame:
    """path, name, line_no, previous_line: bindings of a name that the same source has bound before."""
    before = F.lag("line_no").over(Window.partitionBy("path", "name").orderBy("seq"))
    return names.withColumn("previous_line", before).where("previous_line IS NOT NULL").select("path", "name", "line_no", "previous_line")


def sql_fragments(sources: DataFrame) -> DataFrame:
    """path, start_line, end_line, text, dynamic: the first string argument of every spark.sql(...); dynamic if it is an
    f-string, whose text has the parts that are fixed."""

    def run(batches: Iterator) -> Iterator:
        import ast

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for node in ast.walk(_parsed(content) or ast.Module(body=[], type_ignores=[])):
                    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "sql" and isinstance(node.func.value, ast.Name) and node.func.value.id == "spark"):
                        continue
                    texts = [a for a in node.args if isinstance(a, ast.JoinedStr) or isinstance(a, ast.Constant) and isinstance(a.value, str)]
                    if texts:
                        dynamic = isinstance(texts[0], ast.JoinedStr)
                        text = "".join(p.value if isinstance(p, ast.Constant) else "{" + ast.unparse(p.value) + "}" for p in texts[0].values) if dynamic else texts[0].value
                        rows.append((path, node.lineno, node.end_lineno, text, dynamic))
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "text", "dynamic"])

    return sources.where("language = 'python'").select("path", "content").mapInPandas(run, "path string, start_line int, end_line int, text string, dynamic boolean")


SEPARATOR = r"(?m)^# COMMAND ----------"
_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", re.S)


def split_statements(content: str | None) -> list[tuple[int, str]]:
    """(line, text) of the statements between semicolons that no quote or comment holds; empty ones are left out."""
    out, part, line, begun = [], [], 1, 1
    for m in _TOKEN.finditer((content or "") + ";"):
        t = m[0]
        if t == ";":
            if "".join(p for p in part if not p.startswith(("--", "/*"))).strip():
                out.append((begun, "".join(part).strip()))
            part = []
        else:
            if not "".join(part).strip():
                begun = line + t[: len(t) - len(t.lstrip())].count("\n")
            part.append(t)
        line += t.count("\n")
    return out


def statements(sources: DataFrame) -> DataFrame:
    """path, line_no, statement of the SQL sources."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pd.DataFrame([(p, line, s) for p, c in zip(pdf["path"], pdf["content"], strict=True) for line, s in split_statements(c)], columns=["path", "line_no", "statement"])

    return sources.where("language = 'sql'").select("path", "content").mapInPandas(run, "path string, line_no int, statement string")


#: Statements of other engines that Catalyst's parser refuses and that are no mistakes.
FOREIGN = r"(?is)^\s*(vacuum|optimize|create\s+(or\s+refresh\s+)?(live|streaming\s+live)\b|copy\s+into|restore|clone)\b"


def sql_plan_findings(sources: DataFrame, strict: bool = False) -> DataFrame:
    """path, code, line_no from Catalyst's parser: BN001 for a statement that doesn't parse and, if strict, SQ002 for a
    join of two relations without a condition.

    The parser runs in the driver's JVM and needs no catalog.  Distinct statements pass through the driver one
    partition at a time; only the statements with findings are kept there, and are joined back."""
    spark = sources.sparkSession
    each = statements(sources)
    parser = spark._jsparkSession.sessionState().sqlParser()
    found = []
    for row in each.where(~F.col("statement").rlike(FOREIGN)).select("statement").distinct().toLocalIterator():
        try:
            plan = parser.parsePlan(row[0]).toString()
        except Exception as e:  # the parser's refusal is the finding
            if "ParseException" not in type(e).__name__ and "PARSE" not in str(e).upper():
                raise
            found.append((row[0], "BN001"))
            continue
        if strict and re.search(r"Join Inner\s*$", plan, re.M):
            found.append((row[0], "SQ002"))
    hits = spark.createDataFrame(found, "statement string, code string")
    return each.join(hits, "statement").select("path", "code", "line_no")


def notebook_findings(sources: DataFrame) -> DataFrame:
    """path, code, line_no: BP006 for a notebook of over 50 cells, BP007 for one without a text cell."""
    c = F.col("content")
    separators = F.regexp_count(c, F.lit(SEPARATOR))
    book = (separators > 0) | c.startswith("# Databricks notebook source")
    codes = F.array_compact(F.array(F.when(separators >= 50, "BP006"), F.when(~c.rlike(r"(?m)^# MAGIC %md"), "BP007")))
    return sources.where((F.col("language") == "python") & book).select("path", F.explode(codes).alias("code"), F.lit(1).alias("line_no"))


def spliced(lines: DataFrame, most: int = 32) -> DataFrame:
    """path, at, origin, line_no, line: every source with the lines of what it runs (``# MAGIC %run target``, by path) in
    the place of the call.  at orders the lines.  A target that is missing, or that runs its caller, stays a call;
    nesting beyond most raises."""
    target = F.regexp_extract("line", r"^\s*(?:# MAGIC\s+)?%run\s+(\S+)", 1)
    body = lines.select(F.col("path").alias("_path"), F.col("line_no").alias("_no"), F.col("line").alias("_line"))
    todo = lines.select("path", F.array("line_no").alias("at"), F.array("path").alias("chain"), "line_no", "line")
    done, known = None, lines.select(F.col("path").alias("_path")).distinct()
    for _ in range(most):
        named = todo.withColumn("_to", target).join(known.withColumnRenamed("_path", "_known"), F.col("_to") == F.col("_known"), "left")
        calls = F.col("_known").isNotNull() & ~F.array_contains("chain", F.col("_known"))
        kept = named.where(~calls).drop("_to", "_known")
        done = kept if done is None else done.unionByName(kept)
        todo = named.where(calls).join(body, F.col("_known") == F.col("_path")).select("path", F.concat("at", F.array("_no")).alias("at"), F.concat("chain", F.array("_path")).alias("chain"), F.col("_no").alias("line_no"), F.col("_line").alias("line"))
        if todo.isEmpty():
            return done.select("path", "at", F.element_at("chain", -1).alias("origin"), "line_no", "line")
    raise ValueError(f"sources run each other more than {most} deep")
