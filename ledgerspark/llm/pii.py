"""Personal data by weak supervision (native).

Candidates come from one expression per kind.  Three labelers vote on each (1 yes, 0 no, -1 abstains): its format
(checksums, ranges, digit counts), a gazetteer (endings, calling codes, card issuers, key names) and its context (cue
words in front).  Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is;
the posteriors then train the final span classifier, a logistic model over votes and kind, which Spark evaluates as an
arithmetic expression.  What the driver gathers is one count for each pattern: its number is fixed by the kinds and
votes, whatever the input.

Matches are located without a UDF: split() gives the gaps between the matches that regexp_extract_all() gives, and
the running sum of their lengths the code point offsets.  The expressions match what the plain ones of the contract
match; they only add look-behinds and possessive quantifiers so that no run of characters is scanned twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import durable

CONTEXT_CHARS = 40
BASE_KINDS = ("email", "ip", "card", "phone")

# Gazetteers.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "it", "uk", "eu", "us", "nl", "ch", "at", "be")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "55", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|3[068])"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b",
}


@dataclass(frozen=True)
class Kind:
    name: str
    regex: str
    #: Votes over the match m and the characters before it.
    format: Callable[[Column], Column]
    gazetteer: Callable[[Column, Column], Column]
    #: A substring that every match's text holds; a text without it is not searched.
    needs: str = ""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    each = F.split(F.reverse(_digits(m)), "")
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))
    return F.aggregate(F.transform(F.filter(each, lambda c: c != ""), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).otherwise(-1 if no is None else F.when(no, 0).otherwise(-1))


def _bit(c: Column) -> Column:
    return c.cast("int")


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(1),
         lambda m, b: _bit(F.lower(F.regexp_extract(m, r"\.([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS)), "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: _bit(F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)),
         lambda m, b: _vote(F.regexp_extract(m, "^0*([0-9]+)", 1).cast("double").between(1, 223), F.lit(True)), "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", lambda m: _bit(luhn(m)),
         lambda m, b: _bit(_digits(m).rlike(ISSUERS))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _bit(F.length(_digits(m)).between(9, 15)),
         lambda m, b: _bit(_digits(m).rlike(f"^(?:{'|'.join(CALLING_CODES)})")), "+"),
    Kind("local_phone", r"(?<![0-9+])(?<![0-9+][ ().-])\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])", lambda m: F.lit(1),
         lambda m, b: _bit(~_digits(m).rlike("^[01]")), "("),
    Kind("secret", r"(?<![A-Za-z0-9+/=_-])[0-9a-f]{32,128}+(?![A-Za-z0-9+/=_-])", lambda m: _bit(m.rlike("[a-f]") & m.rlike("[0-9]")),
         lambda m, b: _vote(b.rlike(r"(?i)(?:token|secret|password|passwd|key)\s*[:=]\s*['\x22]?$"))),
)


def matches(text: Column, kind: Kind) -> Column:
    """array<struct<s, e, m, b>>: offsets in code points, the match, and up to CONTEXT_CHARS in front of it (back to
    the match before).  Linear in the text; the array is copied once a match."""
    zipped = F.arrays_zip(F.split(text, kind.regex, -1).alias("g"), F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)).alias("m"))
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")

    def step(a, x):
        s = a["pos"] + F.length(x["g"])
        one = F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("b"))
        return F.struct(F.coalesce(s + F.length(x["m"]), s).alias("pos"), F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(one))).alias("out"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else F.when(text.rlike(kind.regex), found).otherwise(none)


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and spans: array<struct<k, s, e, fmt, gaz, ctx>> by kind, then start.  A null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))

    def votes(k: int, kind: Kind):
        return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), kind.format(x["m"]).alias("fmt"), kind.gazetteer(x["m"], x["b"]).alias("gaz"), _vote(x["b"].rlike(CUES[kind.name])).alias("ctx"))

    return docs.select(*keep, F.concat(*[F.transform(matches(t, kind), votes(k, kind)) for k, kind in enumerate(KINDS)]).alias("spans"))


LABELERS = ("fmt", "gaz", "ctx")


def pattern_counts(spans: DataFrame) -> list[Row]:
    one = spans.select(F.explode("spans").alias("x")).groupBy("x.k", *[f"x.{v}" for v in LABELERS]).agg(F.count(F.lit(1)).alias("n"))
    return sorted(one.collect())


def reliabilities(rows: list[Row], rounds: int = 50) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """EM of the two-class model in which labelers vote independently given the class.  Returns the posterior of each
    pattern (k, votes) and P(vote | class) by (labeler, class, vote).  Starts from the share of yes votes; counts are
    smoothed by one, so no labeler is ever certain."""
    post = {tuple(r)[:-1]: (sum(v == 1 for v in tuple(r)[1:-1]) + 0.5) / (sum(v >= 0 for v in tuple(r)[1:-1]) + 1) for r in rows}
    likes: dict[tuple, float] = {}
    for _ in range(rounds):
        mass: dict[tuple, float] = {}
        prior: dict[tuple, float] = {}
        for r in rows:
            key, n = tuple(r)[:-1], r["n"]
            for c, p in ((1, post[key]), (0, 1 - post[key])):
                prior[key[0], c] = prior.get((key[0], c), 1) + n * p
                for j, v in enumerate(key[1:]):
                    mass[j, c, v] = mass.get((j, c, v), 0) + n * p
        likes = {(j, c, v): (mass.get((j, c, v), 0) + 1) / (sum(mass.get((j, c, u), 0) for u in (-1, 0, 1)) + 3) for j in range(len(LABELERS)) for c in (0, 1) for v in (-1, 0, 1)}
        for key in post:
            odds = math.log(prior[key[0], 1] / prior[key[0], 0]) + sum(math.log(likes[j, 1, v] / likes[j, 0, v]) for j, v in enumerate(key[1:]))
            post[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, likes


def _features(key: tuple) -> list[float]:
    return [float(key[0] == k) for k in range(len(KINDS))] + [float(v == u) for v in key[1:] for u in (0, 1)]


def train(rows: list[Row], post: dict[tuple, float], rounds: int = 400, rate: float = 2.0, ridge: float = 1e-3) -> list[float]:
    """Weights of the final classifier: logistic regression on the posteriors, patterns weighted by log(1 + count)."""
    data = [(_features(k := tuple(r)[:-1]), post[k], math.log1p(r["n"])) for r in rows]
    w = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    total = sum(n for *_, n in data) or 1
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for f, y, n in data:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True))))
            for i, x in enumerate(f):
                grad[i] += n * (p - y) * x / total
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def score(x: Column, w: list[float]) -> Column:
    z = F.element_at(F.array(*map(F.lit, w[: len(KINDS)])), x["k"] + 1)
    for j, name in enumerate(LABELERS):
        no, yes = w[len(KINDS) + 2 * j : len(KINDS) + 2 * j + 2]
        z = z + F.when(x[name] == 1, F.lit(yes)).when(x[name] == 0, F.lit(no)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, base and spans (both array<struct<k, s, e, ...>> by kind, then start); one row per input row.

    base: what the contract's expressions find and their checks pass.  spans: those and what the classifier adds.
    Null and empty texts have none; repeated rows are judged alike.  The candidates are kept in a checkpoint, so texts
    are searched once for training and for the result."""
    found = durable(candidates(docs, text, keep))
    rows = pattern_counts(found)
    w = train(rows, reliabilities(rows)[0])
    is_base = lambda x: (x["k"] < len(BASE_KINDS)) & (x["fmt"] == 1)
    return found.select(*keep, F.filter("spans", is_base).alias("base"), F.filter("spans", lambda x: is_base(x) | (score(x, w) >= 0.5)).alias("spans"))


def rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    rows = find_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(BASE_KINDS)], F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by <kind>; of overlapping spans the one that starts first (then the longest) wins."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["k"].alias("k"))))

    def step(a, x):
        piece = F.concat(F.substring(text, a["pos"] + 1, x["s"] - a["pos"]), F.lit("<"), F.element_at(names, x["k"] + 1), F.lit(">"))
        return F.when(x["s"] < a["pos"], a).otherwise(F.struct((-x["ne"]).alias("pos"), F.concat(a["out"], F.array(piece)).alias("out")))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(by_start, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
