"""Command line: check, rules, doctor, watch, cache, init.  ``python -m ledgerspark check src --fail-on warning``."""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import api, config, reports
from .plans import rules
from .sources.registry import TableRegistry, access_report

CACHE = ".ledgerspark"
TEMPLATE = """# ledgerspark settings
days = 30
select = ["ALL"]
ignore = []
exclude = []
fail_on = "error"

[per_file_ignores]
"""
RENDER = {"text": reports.terminal, "markdown": reports.markdown, "html": reports.html_table, "json": lambda df: "\n".join(reports.json_lines(df))}


def _list(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def check(spark: SparkSession, o: argparse.Namespace) -> int:
    """Findings of a folder, a file or SQL text; exit code 1 if one is as severe as --fail-on."""
    base = config.load(".")
    settings = config.load(".", select=_list(o.select) or None, extend_select=(*base.extend_select, *_list(o.extend_select)), ignore=(*base.ignore, *_list(o.ignore)), fail_on=o.fail_on)
    found = api.check(spark, o.target, settings, strict=o.strict).orderBy("path", "line_no", "code")
    print(RENDER[o.output](found))
    return reports.gate(found, rules.rules_table(spark), settings.fail_on)


def list_rules(spark: SparkSession, o: argparse.Namespace) -> int:
    table = rules.rules_table(spark)
    if o.select:
        table = table.join(rules.active_rules(table, _list(o.select)), "code", "left_semi")
    print(RENDER[o.output](table.orderBy("code")))
    return 0


def doctor(spark: SparkSession, o: argparse.Namespace) -> int:
    """State of Spark, of the settings and of every system table; exit code 1 if no table can be read."""
    print(f"spark {spark.version}\nsettings {config.load('.')}")
    report = access_report(spark, TableRegistry.from_env())
    print(reports.terminal(report.orderBy("table_name")))
    return int(report.where("status = 'OK'").isEmpty())


def watch(spark: SparkSession, o: argparse.Namespace) -> int:
    """Every monitor's report; exit code 1 if one failed.  Run on a schedule, this is the monitoring job."""
    frames, status = api.watch(spark, o.as_of, config.load(".", tag_key=o.tag_key, days=o.days), TableRegistry.from_env())
    for name, state in status.items():
        print(f"{name}: {state}")
        if name in frames:
            print(RENDER[o.output](frames[name]))
            if o.table:
                reports.append_alert(spark, o.table, name, "info", f"{frames[name].count()} rows", o.as_of)
    return int(any(s.startswith("failed") for s in status.values()))


def cache(o: argparse.Namespace) -> int:
    """Shows or clears the files kept beside the settings."""
    folder = Path(CACHE)
    files = sorted(f for f in folder.rglob("*") if f.is_file()) if folder.is_dir() else []
    if o.action == "show":
        print("\n".join([*(f"{f.relative_to(folder)}  {f.stat().st_size} bytes" for f in files), f"total {sum(f.stat().st_size for f in files)} bytes"]) if files else "cache is empty")
    elif files and (o.yes or input(f"Remove {len(files)} files from {folder}? [y/N] ").lower() == "y"):
        shutil.rmtree(folder)
    return 0


def init(o: argparse.Namespace) -> int:
    """Writes a settings file, over an existing one only with --force."""
    path = Path("ledgerspark.toml")
    if path.exists() and not o.force:
        print(f"{path} exists")
        return 1
    path.write_text(TEMPLATE)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerspark", description="Workload cost analytics on Spark")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *, rendered: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        p.set_defaults(run=run)
        if rendered:
            p.add_argument("--output", choices=sorted(RENDER), default="text")
        return p

    p = command("check", check, rendered=True)
    p.add_argument("target")
    for name in ("--select", "--extend-select", "--ignore"):
        p.add_argument(name)
    p.add_argument("--fail-on", choices=rules.SEVERITIES)
    p.add_argument("--strict", action="store_true")
    command("rules", list_rules, rendered=True).add_argument("--select")
    command("doctor", doctor)
    p = command("watch", watch, rendered=True)
    p.add_argument("--as-of", required=True)
    p.add_argument("--tag-key")
    p.add_argument("--days", type=int)
    p.add_argument("--table")
    p = command("cache", cache)
    p.add_argument("action", choices=("show", "clear"))
    p.add_argument("--yes", action="store_true")
    command("init", init).add_argument("--force", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    if o.run in (cache, init):
        return o.run(o)
    return o.run(SparkSession.builder.appName("ledgerspark").getOrCreate(), o)


if __name__ == "__main__":
    sys.exit(main())
