"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and
stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import bpe, decontaminate, near_dedup, pii, quality_model, quality_rules, sharding, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; as extra columns of the input they must not matter.
CLASHES = ("n", "sid", "sketch", "g", "shard", "slot", "spans", "base", "score", "kept", "whole", "_text", "_words", "key", "a", "b", "label", "component_id", "rejected_by", "host", "rule", "_row", "_masked", "first", "s", "e")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
NOTE = "the quick brown fox jumps over the lazy dog and then sleeps in the warm sun of a long afternoon " * 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, NOTE, "en", "s", 1), (2, NOTE, None, None, None), (2, NOTE, None, None, None), (3, None, "en", "s", 1), (4, "", "en", "s", 0), (5, " \t\n", "en", "s", 3), (None, NOTE, "en", "s", 1), (6, LONG, "en", "s", 9), (7, "x" * 60_000, "en", "s", 9), (8, "a b", None, "s", 3), (9, "été 日本 😀", "fr", "s", 9), (10, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 1), (8, 1, None), (None, 1, 1), (9, 1, 0), (6, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, NOTE[:90]), (2, None), (3, ""), (4, "short"), (None, NOTE[10:100]), (5, NOTE[:90])], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, labels, b: near_dedup.near_duplicates(d, 3, 85),
    "op2": lambda d, labels, b: sharding.assign_shards(d),
    "op3": lambda d, labels, b: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op5": lambda d, labels, b: quality_model.score_documents(d, labels),
    "op7": lambda d, labels, b: toxicity.score_documents(d, labels),
    "op8": lambda d, labels, b: pii.pii_report(d),
    "op9": lambda d, labels, b: quality_rules.quality_report(d, quality_rules.QualityCascade().fit(d)),
    "op10": lambda d, labels, b: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, benchmark, name):
    rows = OPERATORS[name](docs, labels, benchmark).collect()
    ids = sorted(str(r["doc_id"]) for r in rows)
    assert ids == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    nothing = hashlib.sha256(b"").hexdigest()
    if name == "op1":
        assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in of[3] + of[4] + of[5]] == [(0, 3, True), (0, 4, True), (0, 5, True)]
        assert {(r["component_id"], r["kept"]) for r in of[2]} == {(1, False)} and of[None][0]["component_id"] is None and of[8][0]["n_shingles"] == 1
    if name == "op2":
        assert of[3][0]["size"] == 1 and of[3][0]["text_crc32"] == 0
        counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in range(8))
    if name == "op3":
        assert (of[3][0]["n_tokens"], of[3][0]["ids_sha256"], of[3][0]["decoded_sha256"]) == (0, nothing, nothing)
        assert of[7][0]["decoded_sha256"] == hashlib.sha256(b"x" * 60_000).hexdigest()
    if name in ("op5", "op7"):
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    if name == "op8":
        assert (of[3][0]["n_email"], of[3][0]["base_sha256"], of[3][0]["spans"]) == (0, nothing, "")
    if name == "op9":
        assert of[3][0]["n_words"] == 0 and of[3][0]["base_failed"] and not of[3][0]["kept"]
    if name == "op10":
        assert of[1][0]["n_removed"] == 0 and all(r["n_removed"] == r["n_bytes"] for r in of[2]) and of[None][0]["n_removed"] == 0
        assert of[3][0]["n_bytes"] == 0 and of[3][0]["kept_sha256"] == nothing


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, labels, benchmark, name):
    assert OPERATORS[name](empty, labels, benchmark).count() == 0


def test_no_labels(docs, labels):
    none = labels.where("false")
    assert len({r["score"] for r in quality_model.score_documents(docs, none).collect()}) == 1
    assert len({r["score"] for r in toxicity.score_documents(docs, none).collect()}) == 1


def test_leaks(docs, empty, benchmark):
    rows = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted({str(r["doc_id"]) for r in rows}) == ["1", "2", "None"] and {r["item_id"] for r in rows} == {1, None, 5}
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.where("false")).count() == 0
    blocks = decontaminate.find_leaks(docs, benchmark, block_bytes=64)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, rows))


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "https://WWW.Example.COM/en/x?y#z"), (5, "https://WWW.Example.COM/en/x?y#z"), (None, "http://a.net/es/" + "x" * 50_000), (6, "x://com"), (7, "x://evilcom/"), (8, "http://buy.cheap-pills.example.org/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASHES})
    rules = [url_filter.host_rule(*r) for r in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))]
    out = url_filter.filter_urls(pages, rules)
    got = {r["page_id"]: (r["host"], r["path"][:6], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[None][2:] == ("net/es/", "block") and got[6] == ("com", "", None, "allow") and got[7][2] is None and got[8][3] == "block"
    many = [url_filter.UrlRule(f"r{i}", f"never{i}", (f"never{i}",), "block", 1) for i in range(url_filter.INLINE_RULES)]
    joined = url_filter.filter_urls(pages, rules, [*url_filter.PATTERN_RULES, *many])
    assert sorted(map(str, joined.collect())) == sorted(map(str, out.collect()))
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_login_page_with_a_longer_ending(spark):
    rows = [(1, "http://a.org/wp-login.php5"), (2, "http://a.org/wp/login")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [url_filter.host_rule("never.net", "/", "allow")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_stages(docs, empty, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, empty):
        total = table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(table.sparkSession, table, str(tmp_path))
            assert out.count() <= total
            if name != "bpe":
                assert out.columns == table.columns and out.dtypes == table.dtypes
    kept = corpus_pipeline.drop_near_duplicates(docs.sparkSession, docs, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    clean = corpus_pipeline.drop_leaks(docs.sparkSession, docs, str(tmp_path))
    assert {str(r["doc_id"]) for r in clean.collect()} == {"3", "4", "5", "6", "7", "8", "9", "10"}
