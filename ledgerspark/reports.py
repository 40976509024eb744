"""Renderings and alerts of small results.  Senders are functions that the caller supplies."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, limit: int | None = None) -> tuple[list[str], list[list[str]]]:
    """Header and rows as text: all rows or, if the caller sets a limit, that many and a row that says how many are left
    out."""
    shown = df if limit is None else df.limit(limit)
    rows = [["" if v is None else str(v) for v in row] for row in shown.toLocalIterator()]
    if limit is not None and len(rows) == limit and (more := df.count() - limit) > 0:
        rows.append([f"... {more} more rows", *[""] * (len(df.columns) - 1)])
    return df.columns, rows


def markdown(df: DataFrame, limit: int | None = None) -> str:
    head, rows = cells(df, limit)
    line = lambda x: "| " + " | ".join(v.replace("|", "\\|") for v in x) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def html_table(df: DataFrame, limit: int | None = None) -> str:
    head, rows = cells(df, limit)
    row = lambda tag, x: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in x) + "</tr>"
    return "<table>" + row("th", head) + "".join(row("td", x) for x in rows) + "</table>"


def terminal(df: DataFrame, limit: int | None = None) -> str:
    head, rows = cells(df, limit)
    width = [max(map(len, c)) for c in zip(head, *rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, width, strict=True)).rstrip() for x in [head, ["-" * w for w in width], *rows])


def json_lines(df: DataFrame) -> list[str]:
    """Every row as a line of JSON."""
    return list(json_line_stream(df))


def json_line_stream(df: DataFrame) -> Iterator[str]:
    """Every row as a line of JSON, one partition at a time."""
    return (r[0] for r in df.select(F.to_json(F.struct("*"))).toLocalIterator())


def write_json_lines(df: DataFrame, folder: str) -> None:
    """Every row as a line of JSON, written by the executors."""
    df.write.mode("overwrite").json(folder)


def job_bundle(name: str, config: dict) -> str:
    """A bundle's YAML for one cluster."""
    lines = ["resources:", "  jobs:", f"    {name}:", f"      name: {json.dumps(name)}", "      job_clusters:", "        - job_cluster_key: main", "          new_cluster:"]
    return "\n".join(lines + [f"            {k}: {json.dumps(v)}" for k, v in config.items() if v is not None]) + "\n"


def watch_message(report: DataFrame, title: str = "Cost watch", most: int = 50) -> str:
    """Text of a watch report: the most largest drifts and idle clusters of each kind, with the number of those left
    out, and the total unless it is 0."""
    size = F.row_number().over(Window.partitionBy("monitor").orderBy(F.desc(F.abs("value")), "key"))
    shown = report.where("monitor <> 'tag'").withColumn("_r", size).where(F.col("_r") <= most)
    rows = sorted((r["monitor"], r["key"], r["value"]) for r in shown.collect())
    counts = {r["monitor"]: r["count"] for r in report.groupBy("monitor").count().collect()}
    rest = lambda kind: [f"and {counts[kind] - most} more {kind}"] if counts.get(kind, 0) > most else []
    out = [title]
    out += [f"drift {k}: {v:+.1%}" for m, k, v in rows if m == "drift"] + rest("drift")
    out += [f"idle {k}: ${v:,.2f} wasted" for m, k, v in rows if m == "idle"] + rest("idle")
    out += [f"total ${v:,.2f}" for m, _, v in rows if m == "total" and v]
    return "\n".join(out)


def payload(channel: str, message: str, severity: str = "warning") -> dict:
    """Body of a POST to a slack, teams or webhook channel."""
    if channel == "slack":
        return {"text": message}
    if channel == "teams":
        return {"@type": "MessageCard", "@context": "https://schema.org/extensions", "summary": message.split("\n")[0], "text": message.replace("\n", "\n\n")}
    return {"severity": severity, "message": message}


def dispatch(message: str, channels: Iterable[tuple[str, Callable[[dict], None]]], severity: str = "warning") -> dict[str, str]:
    """Sends to every channel; what each came to, 'sent' or the failure.  One failure doesn't keep others from sending."""
    out = {}
    for name, send in channels:
        try:
            send(payload(name, message, severity))
            out[name] = "sent"
        except Exception as e:  # reported, per channel
            out[name] = f"failed: {e}"
    return out


def append_alert(spark, table: str, source: str, severity: str, message: str, moment: str) -> None:
    """Appends (source, severity, message, timestamp) to a table."""
    row = spark.createDataFrame([(source, severity, message, moment)], "source string, severity string, message string, timestamp string")
    row.select("source", "severity", "message", F.col("timestamp").cast("timestamp")).write.mode("append").saveAsTable(table)


def gate(findings: DataFrame, rules: DataFrame, fail_on: str = "error") -> int:
    """Exit code: 1 if there is a finding of that severity or worse."""
    from .plans.rules import at_least

    return int(not at_least(findings, rules, fail_on).isEmpty())
