"""Quality rules (native): a short-circuit cascade ordered by rejection per cost.

Each rule is a cheap or dear test on a text.  ``QualityCascade.fit`` times every rule on a sample and counts what it
rejects, then orders the rules by rejection per second; a text leaves the cascade at the first rule that rejects it,
so dear rules see only what cheap ones let through.  The verdict doesn't depend on the order; the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, words

#: Expected rows that the order of the rules is estimated on; it bounds the cost of fit() and nothing else.
SAMPLE_ROWS = 2_000


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    return F.aggregate(F.array(lines), F.lit(0), lambda acc, x: acc + F.size(x) - F.size(F.array_distinct(x)))


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def n_repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that the text holds at least twice.

    Windows are compared as strings with their position behind, sorted once: n log n for a text of n words."""

    def windows(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(wins):
        keyed = F.array_sort(F.transform(wins, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def repeated(s):
            same = lambda i, j: F.get(s, i)["w"] == F.get(s, j)["w"]
            hit = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            at = F.array_sort(F.transform(hit, lambda x: x["i"]))
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        return _let(keyed, repeated)

    # equal windows have equal hashes: where all hashes differ, nothing repeats and nothing need be sorted
    def counted(wins):
        hashes = F.transform(wins, lambda x: F.xxhash64(x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(wins), F.lit(0)).otherwise(covered(wins))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(_let(ws, lambda w: _let(windows(w), counted)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, evaluated once: Spark would inline a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Rule:
    """rejects judges a text and its words, counted the counts that quality_report has made of them."""

    name: str
    rejects: Callable[[], Column]
    counted: Callable[[], Column]


def default_rules(text: str = "_text", ws: str = "_words") -> list[Rule]:
    t, w = F.col(text), F.col(ws)
    return [
        Rule("few_words", lambda: F.size(w) < 50, lambda: F.col("n_words") < 50),
        Rule("many_symbols", lambda: 5 * n_symbols(t) > F.size(w), lambda: 5 * F.col("n_symbols") > F.col("n_words")),
        Rule("odd_word_length", lambda: (word_chars(t) < 2 * F.size(w)) | (word_chars(t) > 15 * F.size(w)), lambda: ~F.col("word_chars").between(2 * F.col("n_words"), 15 * F.col("n_words"))),
        Rule("repeated_lines", lambda: 2 * n_dup_lines(t) > n_lines(t), lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("repeated_words", lambda: 2 * n_repeat_words(w) > F.size(w), lambda: 2 * F.col("n_repeat_words") > F.col("n_words")),
    ]


@dataclass
class QualityCascade:
    rules: list[Rule] = field(default_factory=default_rules)
    report: list[tuple[str, float, float]] = field(default_factory=list)

    def fit(self, docs: DataFrame, text: str = "text") -> QualityCascade:
        """Orders the rules.  report, in the new order: name, seconds beyond those of an idle pass over the sample, and
        the share rejected of the sample's rows that the rules before let through."""
        # a row count costs a look at the files' footers; sample() needs no shuffle where limit() gathers rows of every task
        share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
        sample = _prepared(docs.sample(share, seed=1), text).select("_text", "_words").cache()
        sample.count()

        def seconds(condition: Column) -> float:
            began = time.perf_counter()
            sample.where(condition).count()
            return time.perf_counter() - began

        idle = min(seconds(F.size("_words") >= 0) for _ in range(2))
        cost = {r.name: max(1e-4, seconds(r.rejects()) - idle) for r in self.rules}
        # a row for each set of rules that reject alike
        verdicts = [F.coalesce(r.rejects(), F.lit(False)).alias(r.name) for r in self.rules]
        left = [r.asDict() for r in sample.select(*verdicts).groupBy(*[r.name for r in self.rules]).count().collect()]
        sample.unpersist()
        self.report, todo = [], {r.name: r for r in self.rules}
        while todo:  # each next rule by what it rejects of the rows that the ones before let through
            rows = max(1, sum(x["count"] for x in left))
            share = {n: sum(x["count"] for x in left if x[n]) / rows for n in todo}
            best = max(todo, key=lambda n: share[n] / cost[n])
            self.report.append((best, cost[best], share[best]))
            left = [x for x in left if not x[best]]
            del todo[best]
        by_name = {r.name: r for r in self.rules}
        self.rules = [by_name[n] for n, _, _ in self.report]
        return self

    def rejected_by(self, counted: bool = False) -> Column:
        """Name of the first rule in the cascade's order that rejects; CASE evaluates no branch behind it.  counted: from
        the columns that quality_report has made."""
        case = F
        for r in self.rules:
            case = case.when(r.counted() if counted else r.rejects(), r.name)
        return case.otherwise(F.lit(None).cast("string"))

    def apply(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """keep, _text, _words and rejected_by (null: kept).  A null text has no words and is rejected."""
        return _prepared(docs, text, keep).withColumn("rejected_by", self.rejected_by())


def _prepared(docs: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, t.alias("_text"), words(t).alias("_words"))


def quality_report(docs: DataFrame, cascade: QualityCascade) -> DataFrame:
    """doc_id, the counts, base_failed and kept; one row per input row, repeated rows each on their own.  As every count
    is a result, each is made once and the cascade judges from the counts; it is apply() that skips dear rules."""
    rows = _prepared(docs, "text", ("doc_id",))
    n = F.size("_words")
    stats = rows.select("doc_id", n.cast("long").alias("n_words"), word_chars(F.col("_text")).cast("long").alias("word_chars"), n_symbols(F.col("_text")).cast("long").alias("n_symbols"), n_dup_lines(F.col("_text")).cast("long").alias("n_dup_lines"), n_repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"), n_lines(F.col("_text")).alias("n_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & cascade.rejected_by(counted=True).isNull()).alias("kept"))
