"""A corpus of small sources, one for each document, and what the rules say of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import read

#: (language, content, findings in parity mode as (code, line), those that its comments suppress)
SNIPPETS = (
    ("python", "df = spark.read.table('t')\nresult = df.collect()\nprint(result)", (("BP008", 2), ("BNT-N01", 1)), ()),
    ("sql", "select * from t where a = 1", (("SQ001", 1),), ()),
    ("sql", "select * from t limit 5", (), ()),
    ("sql", "select a from t where b not in (select b from u)", (("BQ001", 1), ("BQ004", 1)), ()),
    ("python", "for c in cols:\n    x = x.withColumn(c, lit(1))\n", (("BP020", 2),), ()),
    ("python", "a = spark.read.parquet('p').cache()\na.count()", (("BP030", 1), ("BP031", 1), ("BP016", 2)), ()),
    ("python", "n = orders.filter('x').count()\nm = orders.count()", (), ()),
    ("python", "x = spark.read.format('jdbc').load()", (("BP021", 1),), ()),
    ("python", "w = Window.orderBy('a')", (("BP023", 1),), ()),
    ("python", "from pyspark.sql.functions import *\ny = df['a'] + 1", (("BNT-I01", 1), ("BNT-C01", 2)), ()),
    ("sql", "VACUUM t\n", (("BD001", 1),), ()),
    ("sql", "select count(distinct a) from t", (("BQ003", 1),), ()),
    ("python", "# MAGIC %md\n# MAGIC sql select 1\nz = 1", (("BP003", 1), ("BP003", 2), ("BP004", 2)), ()),
    ("python", "@udf.register\ndef f(x):\n    return x\ng = udf(f)\nh = t.repartition(1)\nk = t.crossJoin(u).toPandas()", (("BP010", 1), ("BP012", 5), ("BP014", 6), ("BP011", 6)), ()),
    ("python", "@dlt.table(name='x')\ndef x():\n    return spark.readStream.table('y')", (("SDP001", 1), ("SDP002", 1), ("SDP004", 1), ("SDP005", 1), ("SDP003", 3)), ()),
    ("python", "def broken(:\n  pass", (("BN001", 1),), ()),
    ("python", "b = t.filter('a')\nb.show()\nb.count()", (("BP016", 3),), ()),
    ("python", "c = t.take(5)\nprint(c.first())\nc.show()", (("BP032", 1), ("BP032", 2), ("BP032", 3)), ()),
    ("python", "x = sdp.read('a').collect()", (("BP022", 1), ("BP008", 1)), ()),
    ("python", "df1 = t.collect()  # ledger: ignore[BP008]\n# ledger: ignore\ndf2 = t.toPandas()", (("BP008", 1), ("BNT-N01", 1), ("BNT-N01", 3), ("BP011", 3)), (("BP008", 1), ("BNT-N01", 3), ("BP011", 3))),
    ("sql", "create table a as select x, count(*) from b join c on b.i = c.i group by x;\nselect * from a limit 3;\nmerge into a using d on a.i = d.i when matched then delete", (), ()),
    ("sql", "create streaming table s as select y from z;\nexplain select 1 from s", (), ()),
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content: a snippet for each document, by its id."""
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), pick(0).alias("language"), pick(1).alias("content"))


def golden(which: int) -> str:
    """DuckDB text of the findings (2) or suppressed findings (3) of the corpus."""
    rows = ", ".join(f"({i}, '{code}', {line})" for i, s in enumerate(SNIPPETS) for code, line in s[which])
    return f"SELECT 'doc_' || doc_id AS path, code, CAST(line AS INT) AS line_no FROM documents JOIN (VALUES {rows}) g(sid, code, line) ON doc_id % {len(SNIPPETS)} = sid"
