"""Operators against brute force, round trips, oracles and held-out labels."""

import bisect
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import bpe, decontaminate, near_dedup, pii, queries, quality_rules, suffix_dedup, toxicity
from ledgerspark.llm.components import least_labels
from ledgerspark.llm.common import table

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def variants(n=60, seed=5):
    """Texts of all lengths with many near copies."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "du", "fi", "ge", "ha", "ki") for b in ("l", "m", "nd", "r", "st", "x")]
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 9, 12, 20, 40, 90, 300]))
        for _ in range(rng.randint(1, 5)):
            rows.append(" ".join(words))
            words = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in words]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [f"{passage} {' '.join(rng.choices(vocabulary, k=30))}" for _ in range(60)]
    base = rng.choices(vocabulary, k=120)
    rows += [" ".join(w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base) for _ in range(120)]
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent, small_list", [(3, 85, 24), (5, 80, 24), (3, 85, 2), (5, 80, 3)])
def test_near_duplicates(spark, monkeypatch, width, percent, small_list):
    monkeypatch.setattr(near_dedup, "SMALL_LIST", small_list)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = variants()
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root(i)) for i, s in sets.items()}


def linked(spark, pairs, width, percent):
    """How many of the pairs of texts, which share nothing with each other, come into one component."""
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).where("not kept").collect()
    assert all(r["component_id"] == r["doc_id"] - 1 and r["doc_id"] % 2 for r in got)
    return len(got)


def extended(name, n, m, width):
    """A text of m shingles and its beginning of n."""
    words = [f"{name}x{k}" for k in range(m + width - 1)]
    return " ".join(words[: n + width - 1]), " ".join(words)


@pytest.mark.parametrize("width, percent, n, m", [(5, 80, 40, 50), (3, 85, 46, 54), (5, 80, 240, 300), (3, 85, 595, 700)])
def test_pairs_at_the_threshold(spark, width, percent, n, m):
    pairs = [extended(f"p{i}", n, m, width) for i in range(300 if m < 60 else 40)]
    assert linked(spark, pairs, width, percent) == len(pairs)


@pytest.mark.parametrize("width, percent", [(5, 80), (3, 85)])
def test_unions_at_the_threshold(spark, width, percent):
    pairs = []
    for union in range(5, 201):
        common = -(-union * percent // 100)
        for n in {common, common + (union - common) // 2, common + (union - common) // 3}:
            words = [f"u{union}n{n}w{k}" for k in range(union + width - 1)]
            pairs.append((" ".join(words[: n + width - 1]), " ".join(words[n - common :])))
    different = sum(a != b for a, b in pairs)
    assert different > 350 and linked(spark, pairs, width, percent) == len(pairs)


def test_an_id_on_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(2, a), (5, a), (5, b), (7, b), (9, "other text of its own here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {2: 2, 5: 2, 7: 2, 9: 9}


def test_small_sets_at_the_threshold(spark):
    pairs, want = [], 0
    for common in range(1, 17):
        for before in range(3):
            for after in range(3):
                for k in range(8):
                    words = [f"c{common}b{before}a{after}k{k}w{i}" for i in range(before + common + after + 4)]
                    pairs.append((" ".join(words[: len(words) - after]), " ".join(words[before:])))
                    want += 100 * common >= 80 * (common + before + after)
    assert linked(spark, pairs, 5, 80) == want


def test_components_of_a_path(spark):
    n = 60
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a long, b long")
    labels = {r["node"]: r["label"] for r in least_labels(links).collect()}
    assert labels == dict.fromkeys(range(n), 0) | {100: 100, 101: 100}


def test_shards_keep_equal_texts_together(spark):
    from ledgerspark.llm.sharding import assign_shards

    rows = [(i, f"text {i % 7 if i < 300 else i}") for i in range(1000)] + [(2000 + i, "hot") for i in range(500)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    of = {r["doc_id"]: r["shard"] for r in got}
    places = collections.defaultdict(set)
    for i, t in rows:
        places[t].add(of[i])
    assert all(len(v) == 1 for t, v in places.items() if t != "hot")


def test_a_text_over_the_quota_fills_shards(spark):
    from ledgerspark.llm.sharding import assign_shards

    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(2400)]
    hot = collections.Counter(r["shard"] for r in assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] % 3 == 0)
    assert len(hot) == 3 and max(hot.values()) <= 300 and sum(n * n for n in hot.values()) > 0.98 * (300**2 + 300**2 + 200**2)


def test_bpe(spark, sf_dir, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op3_bpe(spark, sf_dir).collect():
        ids = exact.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_appends_and_edits():
    own = bpe.PrefixBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"aeithns ") for _ in range(rng.randint(1, 40)))
        t = bpe.PrefixTable(own)
        for k in range(0, len(data), 7):
            t.append(data[k : k + 7])
        assert t.ids() == bpe.merge_encode(own.ranks, data)
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        assert t.replace(a, b, b"the").ids() == bpe.merge_encode(own.ranks, data[:a] + b"the" + data[b:])
        assert own.decode(t.ids(a)) == data[:a]


def accuracy(rows, label):
    pairs = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    good, bad = sorted(s for s, y in pairs if y), sorted(s for s, y in pairs if not y)
    return sum(bisect.bisect_left(bad, s) + bisect.bisect_right(bad, s) for s in good) / (2 * len(good) * len(bad))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").collect()
    assert accuracy(queries.op5_quality_model(spark, sf).collect(), {r["doc_id"]: r["quality"] for r in labels}) > 0.95
    assert accuracy(queries.op7_toxicity(spark, sf).collect(), {r["doc_id"]: r["toxic"] for r in labels}) > 0.75


def test_chain_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    trans, emits = rng.normal(size=(2, 2)), [rng.normal(size=n) for n in (1, 4, 6, 0)]
    for e, p in zip(emits, toxicity.marginals(emits, trans), strict=True):
        weight = {y: np.exp(sum(e[t] * y[t] + trans[(0, *y)[t], y[t]] for t in range(len(e)))) for y in itertools.product((0, 1), repeat=len(e))}
        total = sum(weight.values())
        assert np.allclose(p, [sum(w for y, w in weight.items() if y[t]) / total for t in range(len(e))])


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def digits(s):
    return sum(c.isdigit() for c in s)


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m) <= 19 and luhn(m)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15))


def test_personal_data(spark, texts):
    rng = random.Random(4)
    odd = ["a@b.c_d@e.f", "a@a@b.c.d", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "41111111111111111111111", "+1 (487) 555-7209", "+1-2", "é+49 170 1234567 ü a.b@c.de", "token = \"" + "0a" * 20 + "\""]
    odd += ["".join(rng.choice("a1.@+- 2(") for _ in range(40)) for _ in range(300)]
    rows = [*texts.items(), *((10_000 + i, t) for i, t in enumerate(odd))]
    for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]] if r["doc_id"] < 10_000 else odd[r["doc_id"] - 10_000]
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, p, ok in BASE}
        spans = [f"{k}:{a}:{b}" for k, v in found.items() for a, b in v]
        assert [r[f"n_{k}"] for k in found] == [len(v) for v in found.values()], text
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_masking(spark):
    t = "é a.b@c.de and +49 170 1234567!"
    row = pii.find_spans(spark.createDataFrame([(t,)], "text string"), keep=("text",)).select(pii.masked(F.col("text"), F.col("spans"))).first()
    assert row[0] == "é <email> and <phone>!"


def test_leaks_with_edits(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    items = [(i, "".join(rng.choices(letters, k=rng.choice([60, 90, 200])))) for i in range(12)]
    rows, want = [], set()
    for i, t in items:
        noise = lambda: "".join(rng.choices(letters, k=400))
        rows += [(10 * i, noise() + t + noise()), (10 * i + 1, noise())]
        want.add((10 * i, i))
        edited = list(t)
        for p in range(20, len(edited), 40):  # two edits a segment at most
            edited[p] = "#"
        rows.append((10 * i + 2, noise() + "".join(edited) + noise()))
        want.add((10 * i + 2, i))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    text, item = dict(rows), dict(items)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == item[r["item_id"]] for r in found if r["doc_id"] % 10 == 0)


def test_passages_of_an_item_at_every_offset():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=n))
    item = noise(400)
    m = decontaminate.Matcher([(1, item), (2, "short item!")])
    for length, edits in ((80, 0), (80, 2), (110, 4)):
        texts = []
        for s in range(len(item) - length + 1):
            passage = list(item[s : s + length])
            for p in rng.sample(range(length), edits):
                passage[p] = "#"
            texts.append(noise(100) + "".join(passage) + noise(100))
        assert all([n for n, *_ in found] == [0] for found in m.find(texts))
    assert m.find(["a short item! here", "a short item here", None]) == [[(1, 2, 13, 1)], [], []]


def removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = t.encode()
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = set()
        for k, g in enumerate(grams):
            if seen.get(g, i) < i:
                gone.update(range(k, k + 50))
        for g in grams:
            seen.setdefault(g, i)
        runs = sum(k in gone and k - 1 not in gone for k in range(len(data)))
        out[i] = (len(data), len(gone), runs, hashlib.sha256(bytes(c for k, c in enumerate(data) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("chunk, meeting", [(4 << 20, 300), (700, 1)])
def test_repeats(spark, texts, monkeypatch, chunk, meeting):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "MEETING", meeting)
    rng = random.Random(7)
    rows = [*texts.items()]
    for k in range(80):
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        i, j = rng.randrange(max(1, len(a))), rng.randrange(max(1, len(b)))
        rows.append((5000 + k, a[i : i + rng.choice([30, 49, 50, 51, 80, 300])] + b[j : j + rng.choice([30, 50, 120])]))
    rows += [(6000, "ab" * 200), (6001, "ab" * 300), (6002, "z" * 49), (6003, "z" * 50), (6004, "z" * 51)]
    pieces = ["".join(rng.choices("abcdef ", k=rng.choice([20, 25, 31, 38, 45, 52, 60]))) for _ in range(25)]
    rows += [(7000 + k, "".join(rng.choices(pieces, k=rng.choice([2, 3, 6, 12, 40])))) for k in range(150)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows)


def test_repeats_of_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    monkeypatch.setattr(suffix_dedup, "MEETING", 1)
    rng = random.Random(3)
    a, b, c = ("".join(rng.choices("abcdefgh", k=120)) for _ in range(3))
    rows = [(1, a), *[(2, f"{k}{b}{k}") for k in range(12)], (2, a), (3, b), (3, c), (4, c + b)]
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 120, 0), *[(2, len(f"{k}{k}") + 120, 0) for k in range(12)], (2, 120, 120), (3, 120, 120), (3, 120, 0), (4, 240, 240)]
    assert got == collections.Counter(want)


def test_repeats_are_equal_to_the_last_byte(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ", k=49)) for _ in range(40)]
    # the first byte of each of these is the letter's with its top bit set
    rows = [(2 * k, f"{t}{'CbBdp'[k % 5]}{k:07}") for k, t in enumerate(texts)] + [(2 * k + 101, f"#{t}{'é—§中😀'[k % 5]}{k:07}") for k, t in enumerate(texts)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows)
    assert not any(r["n_removed"] for r in got)
    for size in (30, 50):
        data = bytes(rng.choices(range(128), k=size))
        changed = [data] + [data[:k] + bytes([data[k] ^ 1 << b]) + data[k + 1 :] for k in range(size) for b in range(8)]
        hashes = suffix_dedup._hashes_at(b"".join(changed), size * np.arange(len(changed)), size)
        assert all(len(set(h.tolist())) == len(changed) for h in hashes)


def test_repeats_keep_large_ids_and_any_bytes(spark):
    rows = [(None, b"a"), (2**53 + 1, b"b"), (2**53 + 3, None), (None, None), (-3, b"\xff" + b"q" * 60), (-2, b"ab" + b"q" * 60 + b"\x80"), (-1, b"\x80")]
    docs = spark.createDataFrame([(i, t and bytearray(t)) for i, t in rows], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    want = {(i, len(t or b""), hashlib.sha256(b"ab\x80" if i == -2 else t or b"").hexdigest()) for i, t in rows}
    for with_text in (False, True):
        got = suffix_dedup.remove_repeats(docs, with_text).collect()
        assert {(r["doc_id"], r["n_bytes"], r["kept_sha256"]) for r in got} == want and len(got) == len(rows)
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got if with_text)


def test_cascade_order_does_not_change_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = quality_rules.QualityCascade()
    other = quality_rules.QualityCascade(rules=plain.rules[::-1])
    kept = [sorted(r["doc_id"] for r in quality_rules.quality_report(docs, c).where("kept").collect()) for c in (plain, other)]
    assert kept[0] == kept[1]


@pytest.mark.parametrize("name", ["op4_url_filter", "op8_pii", "op9_quality_rules"])
def test_native(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf_dir, texts):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.PrefixBpe(ranks, public_tokenizers.PATTERN)
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, sf_dir, "documents")).collect()}
    decoded = {r["doc_id"]: own.decode([int(x) for x in r["ids"].split()]).decode() for r in out}
    assert 0.5 * len(texts) < len(out) < len(texts)
    assert not any(item in t for t in decoded.values() for item in items)
    assert max(collections.Counter(near[i] for i in decoded).values()) == 1
    assert not any(re.search(BASE[0][1], t) for t in decoded.values())
    same = [i for i, t in decoded.items() if t == texts[i]]
    assert len(same) > 0.8 * len(decoded)
