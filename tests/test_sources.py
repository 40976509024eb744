"""Settings, globs, command line, renderings without cuts, notebooks and logs read from files."""

import io
import json
import zipfile


from ledgerspark import api, cli, config, reports
from ledgerspark.plans import rules, semantics
from ledgerspark.sources import corpus


def test_globs(spark):
    import re

    fits = lambda glob, path: bool(re.match(rules.glob_regex(glob), path))
    assert fits("*.py", "/a/b.py") and not fits("*.py", "/a/b.pyc") and fits("a?.sql", "x/ab.sql") and not fits("a?.sql", "x/ba.sql")
    assert fits("[ab]1.py", "/b1.py") and not fits("[!ab]1.py", "/b1.py") and fits("a+b(1).py", "/z/a+b(1).py") and fits("src/*", "/repo/src/x/y.py")


def test_check_of_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("df.collect()\n")
    (tmp_path / "broken.py").write_text("def f(:\n")
    (tmp_path / "q.sql").write_text("select a from t;\nselec 1")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "b.py").write_text("df.collect()\n")
    found = lambda **o: {(r["path"].rsplit("/", 1)[-1], r["code"], r["severity"]) for r in api.check(spark, str(tmp_path), config.Settings(**o)).collect()}
    assert found(exclude=("old/*",)) == {("a.py", "BP008", "error"), ("broken.py", "BN001", "error"), ("q.sql", "BN001", "error")}
    assert found(exclude=("old/*", "q.sql"), per_file_ignores={"a.py": ("BP",)}) == {("broken.py", "BN001", "error")}
    assert reports.gate(api.check(spark, str(tmp_path), config.Settings(exclude=("a.py", "old/*", "*.sql"))), rules.rules_table(spark)) == 1


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("from pyspark.sql.functions import *\n")
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 1 and cli.main(["cache", "show"]) == 0
    assert cli.main(["check", str(tmp_path / "src")]) == 1 and "BNT-I01" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "src"), "--ignore", "BNT", "--output", "json"]) == 0
    assert cli.main(["rules", "--select", "BQ"]) == 0 and "BQ004" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 1 and "system.billing.usage" in capsys.readouterr().out


def test_renderings_hold_all_rows(spark):
    df = spark.range(2500)
    assert len(list(reports.json_lines(df))) == 2500 and len(reports.markdown(df).split("\n")) == 2502
    assert reports.terminal(df, 10).split("\n")[-1] == "... 2490 more rows"


def test_watch_message_counts_what_it_leaves_out(spark):
    rows = [("drift", f"k{i}", float(i)) for i in range(9)] + [("total", "t", 5.0)]
    text = reports.watch_message(spark.createDataFrame(rows, "monitor string, key string, value double"), most=4)
    assert "drift k8" in text and "drift k1:" not in text and "and 5 more drift" in text and text.endswith("total $5.00")


def test_notebooks(spark, tmp_path):
    book = {"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["%sql\n", "select 1"]}, {"cell_type": "code", "source": "x = 1"}], "metadata": {"kernelspec": {"language": "python", "name": "p"}}}
    (tmp_path / "n.ipynb").write_text(json.dumps(book))
    got = sorted((r["cell_index"], r["language"], r["source"]) for r in corpus.notebook_cells(spark, str(tmp_path)).collect())
    assert got == [(1, "sql", "%sql\nselect 1"), (2, "python", "x = 1")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.python", json.dumps({"language": "python", "commands": [{"command": "y = 2"}, {"command": "%md", "language": "md"}]}))
        z.writestr("readme.txt", "no json")
    (tmp_path / "a.dbc").write_bytes(data.getvalue())
    got = sorted((r["member"], r["cell_index"], r["language"], r["source"]) for r in corpus.archive_cells(spark, str(tmp_path)).collect())
    assert got == [("b.python", 0, "python", "y = 2"), ("b.python", 1, "md", "%md")]


def test_statements():
    assert semantics.split_statements("select 1; -- a;b\n\nselect ';' /* ; */;\n;  \n select 2") == [(1, "select 1"), (1, "-- a;b\n\nselect ';' /* ; */"), (5, "select 2")]


def test_splicing_stops_at_cycles(spark):
    lines = spark.createDataFrame([("a", 1, "%run b"), ("b", 1, "x"), ("b", 2, "# MAGIC %run a"), ("c", 1, "%run gone")], "path string, line_no int, line string")
    got = {(r["path"], tuple(r["at"]), r["origin"], r["line"]) for r in semantics.spliced(lines).collect()}
    assert got == {("a", (1, 1), "b", "x"), ("a", (1, 2), "b", "# MAGIC %run a"), ("b", (1,), "b", "x"), ("b", (2, 1), "a", "%run b"), ("c", (1,), "c", "%run gone")}
