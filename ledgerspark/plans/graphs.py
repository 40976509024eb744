"""Operation graphs of sources: what each reads, moves and writes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First fit wins; pieces of a call's text, kind, scaling, flag.
CALL_KINDS = (
    (("spark.read",), "read", "linear", ""),
    ((".write", ".save"), "write", "linear", ""),
    ((".collect", ".take", ".show"), "action", "step_failure", "driver_bound"),
    ((".groupBy", ".join"), "shuffle", "linear_with_cliff", "shuffle"),
    ((".select", ".filter", ".withColumn"), "transform", "linear", "photon"),
)
NODE = "path string, seq int, kind string, scaling string, flag string, target string, line_no int"
_NAME = r"((?:[A-Za-z_][\w]*|`[^`]+`)(?:\.(?:[A-Za-z_][\w]*|`[^`]+`))*)"


def call_kind(text: str) -> tuple[str, str, str] | None:
    return next(((k, s, f) for pieces, k, s, f in CALL_KINDS if any(p in text for p in pieces)), None)


def python_calls(content: str) -> list[tuple[str, str, str, int]]:
    """(kind, scaling, flag, line) of every call whose text is known, in the order of the source."""
    import ast

    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    calls = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset, -(n.end_col_offset or 0)))
    found = [(call_kind(ast.get_source_segment(content, n) or ""), n.lineno) for n in calls]
    return [(*k, line) for k, line in found if k]


def python_nodes(sources: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = [(p, i, k, s, f, None, line) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, (k, s, f, line) in enumerate(python_calls(c))]
            yield pd.DataFrame(rows, columns=["path", "seq", "kind", "scaling", "flag", "target", "line_no"])

    return sources.where("language = 'python'").select("path", "content").mapInPandas(run, NODE)


def sql_operations(text: str) -> list[list[tuple[str, str, str, str | None]]]:
    """Per statement, its (kind, scaling, flag, target): written table, reads, shuffles of joins and of grouping, and the
    action of a plain query.  EXPLAIN counts as what it explains; other statements do nothing."""
    out = []
    for raw in re.split(r";", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text or "", flags=re.S)):
        s = re.sub(r"'(?:[^']|'')*'", "''", raw).strip()
        s = re.sub(r"(?is)^explain\s+(?:extended|codegen|cost|formatted)?\s*", "", s)
        if not s:
            continue
        ops: list[tuple[str, str, str, str | None]] = []
        merge = re.match(rf"(?is)merge\s+into\s+{_NAME}.*?\busing\s+{_NAME}", s)
        made = re.match(rf"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:streaming\s+|materialized\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?{_NAME}.*?\bas\b(?=\s*[(\s]*(?:select|with))", s)
        if merge:
            ops = [("write", "linear", "", merge[1]), ("read", "linear", "", merge[1]), ("read", "linear", "", merge[2]), ("shuffle", "linear_with_cliff", "shuffle", None)]
        elif made or re.match(r"(?is)[(\s]*(?:select|with)\b", s):
            if made:
                ops.append(("write", "linear", "", made[1]))
                s = s[made.end() :]
            local = {m.lower() for m in re.findall(r"(?is)(?:\bwith|,)\s+([A-Za-z_]\w*)\s+as\s*\(", s)}
            ops += [("read", "linear", "", t) for t in re.findall(rf"(?is)\b(?:from|join)\s+{_NAME}", s) if t.lower() not in local]
            ops += [("shuffle", "linear_with_cliff", "shuffle", None)] * (len(re.findall(r"(?is)\bjoin\b", s)) + bool(re.search(r"(?is)\bgroup\s+by\b", s)))
            if not made:
                ops.append(("action", "step_failure", "driver_bound", None))
        out.append(ops)
    return out


def sql_nodes(sources: DataFrame) -> DataFrame:
    """Nodes of SQL sources; line_no is the statement's number."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                every = [(k, s, f, t, n + 1) for n, ops in enumerate(sql_operations(c)) for k, s, f, t in ops]
                rows += [(p, i, k, s, f, t, n) for i, (k, s, f, t, n) in enumerate(every)]
            yield pd.DataFrame(rows, columns=["path", "seq", "kind", "scaling", "flag", "target", "line_no"])

    return sources.where("language = 'sql'").select("path", "content").mapInPandas(run, NODE)


def sql_edges(nodes: DataFrame) -> DataFrame:
    """path, src, dst, kind: reads to the statement's last shuffle (if any) and that to its write or action; and, between
    statements of a source, the write of a table to each read of it, whatever their order."""
    by = ["path", "line_no"]
    statement = nodes.groupBy(*by).agg(F.max(F.when(F.col("kind") == "shuffle", F.col("seq"))).alias("shuffle"), F.max(F.when(F.col("kind").isin("write", "action"), F.col("seq"))).alias("sink"))
    reads = nodes.where("kind = 'read'").select(*by, F.col("seq").alias("src")).join(statement, by)
    flow = reads.select("path", "src", F.coalesce("shuffle", "sink").alias("dst")).unionByName(statement.select("path", F.col("shuffle").alias("src"), F.col("sink").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL").withColumn("kind", F.lit("flow"))
    defined = nodes.where("kind = 'write'").select("path", "target", F.col("seq").alias("src"), F.col("line_no").alias("_at"))
    used = nodes.where("kind = 'read'").select("path", "target", F.col("seq").alias("dst"), F.col("line_no").alias("_used"))
    across = defined.join(used, ["path", "target"]).where("_at <> _used").select("path", "src", "dst", F.lit("table_dependency").alias("kind"))
    return flow.unionByName(across).distinct()


def pipeline_tables(sources: DataFrame) -> DataFrame:
    """path, table_name, table_kind, expectations, line_no of declared pipeline tables, in Python and SQL."""

    def run(batches: Iterator) -> Iterator:
        import ast

        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"], strict=True):
                if language == "sql":
                    for m in re.finditer(rf"(?i)create\s+(?:or\s+refresh\s+)?(streaming\s+table|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?{_NAME}", content or ""):
                        rows.append((path, m[2], "streaming" if m[1].lower().startswith("stream") else "materialized_view", 0, content.count("\n", 0, m.start()) + 1))
                    continue
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in ast.walk(tree):
                    if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                        continue
                    names = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
                    kinds = [n.split(".")[-1] for n in names if n.split(".")[0] in ("dlt", "sdp", "dp")]
                    declared = [k for k in kinds if k in ("table", "materialized_view", "streaming_table")]
                    if declared:
                        streams = declared[0] == "streaming_table" or "readStream" in ast.unparse(node)
                        rows.append((path, node.name, "streaming" if streams else "materialized_view", sum(k.startswith("expect") for k in kinds), node.lineno))
            yield pd.DataFrame(rows, columns=["path", "table_name", "table_kind", "expectations", "line_no"])

    return sources.select("path", "language", "content").mapInPandas(run, "path string, table_name string, table_kind string, expectations int, line_no int")


def pipeline_edges(sources: DataFrame) -> DataFrame:
    """path, src, dst, kind (sdp_read or live_ref): reads of one pipeline table by another of the same source, by
    sdp.read, dlt.read, dp.read or a LIVE. name."""

    def run(batches: Iterator) -> Iterator:
        import ast

        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"], strict=True):
                if language == "sql":
                    heads = list(re.finditer(rf"(?i)create\s+(?:or\s+refresh\s+)?(?:streaming\s+table|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?{_NAME}", content or ""))
                    ends = [m.start() for m in heads[1:]] + [len(content or "")] * bool(heads)
                    rows += [(path, r, m[1], "live_ref") for m, end in zip(heads, ends, strict=True) for r in re.findall(r"\bLIVE\.(\w+)", content[m.end() : end])]
                    continue
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in (n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)):
                    for n in ast.walk(node):
                        if isinstance(n, ast.Call) and ast.unparse(n.func).startswith(("sdp.read", "dlt.read", "dp.read")) and n.args and isinstance(n.args[0], ast.Constant):
                            rows.append((path, str(n.args[0].value), node.name, "sdp_read"))
                        if isinstance(n, ast.Constant) and isinstance(n.value, str):
                            rows += [(path, r, node.name, "live_ref") for r in re.findall(r"\bLIVE\.(\w+)", n.value)]
            yield pd.DataFrame(rows, columns=["path", "src", "dst", "kind"])

    refs = sources.select("path", "language", "content").mapInPandas(run, "path string, src string, dst string, kind string").distinct()
    tables = pipeline_tables(sources).select("path", "table_name").distinct()
    for end in ("src", "dst"):
        refs = refs.join(tables.withColumnRenamed("table_name", end), ["path", end], "left_semi")
    return refs.select("path", "src", "dst", "kind")


def enriched(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """nodes with the bytes of the table that each reads or writes (sizes: target, bytes)."""
    return nodes.join(sizes, "target", "left")


def graph_cost(nodes: DataFrame, rate: float = 1e-9) -> DataFrame:
    """path, bytes, cost, driver_bound: every source's nodes cost by their scaling; a node without a known table is
    charged with all that its source reads."""
    from ..functions.estimates import scaled

    total = nodes.where("kind = 'read'").groupBy("path").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("_read"))
    each = nodes.join(total, "path", "left").withColumn("_bytes", F.coalesce(F.col("bytes").cast("double"), F.col("_read"), F.lit(0.0)))
    return each.groupBy("path").agg(F.max("_read").alias("bytes"), F.sum(scaled(F.col("scaling"), F.col("_bytes"), F.lit(rate))).alias("cost"), F.max(F.col("flag") == "driver_bound").alias("driver_bound"))
