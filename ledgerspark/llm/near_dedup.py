"""Near-duplicates by bottom-k sketches of one hash function.

A document's set are the 64-bit hashes of its distinct word shingles; its sketch the K least of them.  Equal sets are
one class from the start.  Every class retains its least values, and inverted lists of the retained values generate
overlaps: the number of lists that two classes share.

That no link is lost follows by counting.  Let p(n) = n - ceil(n percent / 100) + 1: of a set of n, fewer than p values
are not in a set that it is linked with.  Each class retains p + e values, e being spare(n).  Of two linked classes, the
one whose last retained value is less has all its retained values but p - 1 in the other's: they share e + 1 lists at
least, e being the lesser spare of the two.  A value that more than SMALL_LIST classes retain is hot, and its list gives
no pairs.  Two linked classes that share no other list share e + 1 hot ones, so both of them are crowded (hold e + 1 hot
values, e being spare of the least size that they can be linked with), and a pair is a candidate if its overlap and the
lesser count of hot values come to e + 1.

Crowded classes are near copies of many, or made of common passages.  They first meet one pivot each: of
the least classes of their hot lists, the one that they share most with.  Then they get a second index, of runs of consecutive values of their
whole sets, which passages that documents share hardly ever fill: at most d = n (100 - percent) / percent elements of
the union are not shared, n being the smaller size, and d of them cut the common ones into d + 1 pieces.  So the union's
first r (d + 1) elements hold a common run of r, and a whole union of c common and d other elements one of c / (d + 1),
rounded up.  Lists of runs all of whose members are linked by then are settled; short ones give their pairs; of the
others, members outside of the group's largest component meet all members, in blocks.

Pairs are filtered by the estimate from the union's sketch and confirmed by the exact overlap of their whole sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, release
from .components import least_labels

#: Least and most values of a sketch; a class has as many as it retains, within these.
K_LEAST, K = 64, 128
SMALL_LIST = 24
#: Classes in a block of the comparison of long lists.
BLOCK = 256
COLUMNS = 1 << 14
#: Run lengths by the smaller set's size: up to WHOLE the longest that its whole union is sure to hold, then LONGEST.
WHOLE, LONGEST = 128, 3
#: Bytes of a value that are kept; tasks that number a group's members by blocks.
HELD, SALTS = 6, 32
#: An estimate from k values may fall this many times (k ** -0.5) below the threshold: five of its standard deviations,
#: which are at most 0.4 times that at 80 percent or more.
MARGIN = 2.0
REMEMBERED = 300_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; words are runs of other than ASCII white space, A-Z in
    lower case.  With fewer words, the whole sequence is the one shingle; without words there is none."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        n = max(1, len(ws) - width + 1)
        mixed = np.full(n, np.uint64(min(len(ws), width)) * _C, dtype=np.uint64)
        for i in range(min(width, len(ws))):
            mixed = _mix(mixed * _A + h[i : i + n] * _B + np.uint64(i))
    return np.unique(mixed)


def prefix(n: int, percent: int) -> int:
    """One more than the most values of a set of n that a set linked with it can lack."""
    return n - -(-n * percent // 100) + 1


def spare(n: int, percent: int) -> int:
    """Retained values beyond prefix(n); never less for a larger set."""
    return min(-(-n * percent // 100) - 1, prefix(n, percent) // 4 + 1) if n else 0


def spare_column(n: Column, percent: int) -> Column:
    """spare of a column of sizes over 0."""
    least = F.ceil(n * percent / F.lit(100))
    return F.least(least - 1, F.floor((n - least + 1) / F.lit(4)) + 1)


def unshared(n: int, percent: int) -> int:
    """The most elements of a union that are not shared, where the smaller set has n and the overlap is percent."""
    return n * (100 - percent) // percent


@functools.cache
def run_length(n: int, percent: int) -> int:
    """Length of the common run that a linked pair of unequal sets is sure to have if the smaller one has n elements;
    0 if there is no such pair."""
    if n > WHOLE:
        least = WHOLE * percent // 100
        return min(LONGEST, *(run_length(x, percent) for x in range(least, WHOLE + 1)))
    # c common elements, and n - c at least on either side that are not
    return min((-(-c // (unshared(c, percent) + 1)) for c in range(1, n + 1) if unshared(c, percent) >= max(1, 2 * (n - c))), default=0)


@functools.cache
def runs_of(n: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(run length, number of least values whose runs are listed) for a set of n, for every size that the smaller set
    of a pair with it can have."""
    reach: dict[int, int] = {}
    low = -(-n * percent // 100)
    for x in (*range(low, min(n, WHOLE) + 1), n):
        if r := run_length(x, percent):
            reach[r] = max(reach.get(r, 0), min(n, r * (unshared(x, percent) + 1)))
    return tuple(sorted(reach.items()))


def run_keys(values: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Hashes of the runs of consecutive values of a set of n, given its least values."""
    out = []
    for r, reach in runs_of(n, percent):
        v = values[:reach]
        m = len(v) - r + 1
        if m < 1:
            continue
        with np.errstate(over="ignore"):
            h = np.full(m, np.uint64(r) * _C, dtype=np.uint64)
            for i in range(r):
                h = _mix(h * _A + v[i : i + m] * _B)
        out.append(h)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """The upper HELD bytes of sorted values."""
    return np.ascontiguousarray((values >> np.uint64(64 - 8 * HELD)).view(np.uint8).reshape(-1, 8)[:, :HELD]).tobytes()


def _unpack(held: bytes, most: int) -> np.ndarray:
    """The first values of a packed set, as integers below 2 ** 48."""
    out = np.zeros((min(most, len(held) // HELD), 8), dtype=np.uint8)
    out[:, :HELD] = np.frombuffer(held, dtype=np.uint8, count=len(out) * HELD).reshape(-1, HELD)
    return out.reshape(-1).view(np.int64)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, sid (identifies the set; null for an empty one), least (the least hashes, packed: those that are
    retained, and K_LEAST at least)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            release()
            n, sid, least = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), width, known)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    sid.append(f"{len(s)}-{int(s.sum(dtype=np.uint64)):x}-{int(np.bitwise_xor.reduce(_mix(s * _B))):x}" if len(s) else None)
                least.append(_pack(s[: max(K_LEAST, prefix(len(s), percent) + spare(len(s), percent))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.string()), pa.array(least, pa.binary())], names=["doc_id", "n", "sid", "least"])
        release()

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, sid string, least binary")


def _rows(values: list[np.ndarray], pdf: pd.DataFrame, *columns: str) -> pd.DataFrame:
    """A row for each of the values, with the columns of the row of pdf that it belongs to."""
    sizes = [len(v) for v in values]
    return pd.DataFrame({"key": np.concatenate([*values, np.zeros(0, dtype=np.int64)]), **{c: np.repeat(pdf[c].to_numpy(), sizes) for c in columns}})


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """key, a, n: a row for each value that a class retains."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield _rows([np.unique(_unpack(s, prefix(n, percent) + spare(n, percent))) for s, n in zip(pdf["least"], pdf["n"], strict=True)], pdf, "a", "n")

    return classes.select("a", "n", "least").mapInPandas(run, f"key long, a {classes.schema['a'].dataType.simpleString()}, n long")


def run_postings(sets: DataFrame, percent: int) -> DataFrame:
    """key, a, label: a row for each run of the whole set s of a class."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield _rows([run_keys(v := np.asarray(s).view(np.uint64), len(v), percent).view(np.int64) for s in pdf["s"]], pdf, "a", "label")

    kind = sets.schema["a"].dataType.simpleString()
    return sets.select("a", "label", "s").mapInPandas(run, f"key long, a {kind}, label {kind}")


def _hopeful(percent: int):
    """Of two packed sketches: whether the threshold is within MARGIN of the estimate, the share of the union's k least
    values that both hold, k being what either sketch has."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.unique(_unpack(x, K)), np.unique(_unpack(y, K))
            union = np.union1d(x, y)[: max(K_LEAST, min(len(x), len(y)))]
            both = np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum()
            out.append(both / len(union) >= percent / 100 - MARGIN * len(union) ** -0.5)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose sizes and sketches allow the threshold."""
    one = lambda c: classes.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"), F.expr(f"substring(least, 1, {K * HELD})").alias(f"least_{c}"))
    sized = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.where(_hopeful(percent)("least_a", "least_b")).select("a", "b")


def whole_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """a, s: the sets of the documents in ids (a), made again from their texts."""

    def whole(texts: pd.Series) -> pd.Series:
        release()
        known = WordHashes()
        return pd.Series([shingle_set(t, width, known).view(np.int64) for t in texts])

    return docs.withColumnRenamed("doc_id", "a").join(ids, "a", "left_semi").select("a", F.pandas_udf(whole, "array<long>")("text").alias("s"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union of their whole sets."""
    both = pairs.join(sets.withColumnsRenamed({"s": "s_a"}), "a").join(sets.withColumnsRenamed({"a": "b", "s": "s_b"}), "b")
    common = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("i"), (F.size("s_a") + F.size("s_b")).alias("total"))
    return common.where(100 * F.col("i") >= percent * (F.col("total") - F.col("i"))).select("a", "b")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _listed(lists: DataFrame, *more: Column) -> DataFrame:
    """lists with the size of each row's list, without lists of one; dealt by key once, for the counts and the join."""
    dealt = lists.repartition("key")
    return dealt.join(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *more).where("size > 1"), "key")


def _incidence(values: list[np.ndarray]) -> Iterator[np.ndarray]:
    """0/1 matrices, a row for each of values and together a column for each value that two of them hold; a matrix has
    at most COLUMNS columns, whatever the sets' sizes."""
    every, at = np.unique(np.concatenate(values), return_inverse=True)
    held = np.bincount(at) > 1
    column = np.cumsum(held) - 1
    row, keep = np.repeat(np.arange(len(values)), [len(v) for v in values]), held[at]
    row, column = row[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(held.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        m = np.zeros((len(values), COLUMNS), dtype=np.float32)
        m[row[a:b], column[a:b] - low] = 1
        yield m


def _shared(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of values that each of the left rows shares with each of the right ones."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for m in _incidence(values):
        out += m[left] @ m[right].T
    return out


def blockwise(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels of the same group (g): of all that a task finds, enough to join them.

    members: g, a, label.  A group's classes are dealt over blocks, and those outside of its most frequent label over
    blocks of their own; every two blocks of either kind meet in one task, whatever a group's size.  Sketches meet
    first and only mark the classes that are likely linked across labels; the whole sets of those meet then."""
    threshold = percent / 100
    members = members.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    counted = members.groupBy("g", "label").agg(F.count(F.lit(1)).alias("size"))
    sized = counted.groupBy("g").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    sized = sized.select("g", "main", blocks(F.col("size")).alias("every"), blocks(F.col("size") - F.col("most")).alias("others"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = members.join(sized, ["g", "salt"]).join(classes.select("a", "n", F.expr(f"substring(least, 1, {K * HELD})").alias("sketch")), "a")
    deal = lambda c: F.pmod(F.xxhash64("a", F.lit(1)), F.col(c)).cast("int")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["g", "a", "label", "n", "sketch"]
    right = dealt.select(*columns, F.lit(False).alias("left"), up_to("others").alias("i"), deal("every").alias("j"))
    left = dealt.where("label != main").select(*columns, F.lit(True).alias("left"), deal("others").alias("i"), up_to("every").alias("j"))
    kind = members.schema["a"].dataType.simpleString()

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        label, n, is_left = pdf["label"].to_numpy(), pdf["n"].to_numpy(), pdf["left"].to_numpy()
        x, y = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        # the values that two sketches share are at least those that the union's sketch counts for the estimate
        sketch = [np.unique(_unpack(s, K)) for s in pdf["sketch"]]
        common, size = _shared(sketch, x, y), np.array([len(s) for s in sketch])
        held = np.minimum(size[x][:, None], size[y][None, :])
        small, large = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
        good = (100 * small >= percent * large) & (common >= (threshold - MARGIN * held**-0.5) * held) & (label[x][:, None] != label[y][None, :])
        hit = np.zeros(len(pdf), dtype=bool)
        hit[x[good.any(axis=1)]] = True
        hit[y[good.any(axis=0)]] = True
        return pdf.loc[hit, ["g", "i", "j", "left", "a", "label"]]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, label, is_left = pdf["a"].to_numpy(), pdf["label"].to_numpy(), pdf["left"].to_numpy()
        sets = [np.asarray(s) for s in pdf["s"]]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        common = _shared(sets, left, right)
        x, y = np.nonzero((100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (label[left][:, None] != label[right][None, :]))
        of: dict = {}

        def top(v):
            while (w := of.get(v, v)) != v:
                of[v] = of.get(w, w)
                v = w
            return v

        out = []
        for a, b in zip(left[x], right[y], strict=True):
            if (u := top(label[a])) != (v := top(label[b])):
                of[v] = u
                out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pd.DataFrame(out, columns=["a", "b"])

    marked = durable(right.unionByName(left).groupBy("g", "i", "j").applyInPandas(mark, f"g {kind}, i int, j int, left boolean, a {kind}, label {kind}"))
    return marked.join(sets, "a").groupBy("g", "i", "j").applyInPandas(link, f"a {kind}, b {kind}").distinct()


def named(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (a) with their label: their own id where they have no link."""
    return nodes.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))


def crowded_links(crowded: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the labels of crowded classes (a, label), enough to join all that belong together."""
    at = durable(crowded.join(sets, "a"))
    split = [F.min("label").alias("low"), F.max("label").alias("high")]
    runs = durable(_listed(run_postings(at, percent), *split).where("low < high"))

    short = runs.where(F.col("size") <= SMALL_LIST).select("key", "a", "label")
    pairs = short.join(short.withColumnsRenamed({"a": "b", "label": "other"}), "key").where("a < b and label != other").select("a", "b").distinct()
    links = confirmed(durable(likely(pairs, classes, percent)), sets, percent)

    long = runs.where(F.col("size") > SMALL_LIST)
    if not long.isEmpty():
        # labels are grouped over the lists that they meet in
        groups = least_labels(long.select(F.col("label").alias("a"), F.col("low").alias("b")).distinct())
        members = long.select("a", "label").distinct().join(groups.select(F.col("node").alias("label"), F.col("label").alias("g")), "label")
        links = links.unionByName(blockwise(durable(members), classes, sets, percent))
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (doc_id is component_id).

    One row per input row.  Null and empty texts, and texts of white space, have an empty set and are linked with
    nothing.  A null id takes no part: its component is null and it is kept.  Rows that share an id are one node, also
    where their texts differ.  Other columns are not read."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = durable(sketches(docs, width, percent))
    known = every.where(F.col("sid").isNotNull() & F.col("doc_id").isNotNull())
    classes = durable(known.groupBy("sid").agg(F.min("doc_id").alias("a"), F.min("n").alias("n"), F.min("least").alias("least")))

    listed = durable(_listed(postings(classes, percent)))
    hot = durable(listed.where(F.col("size") > SMALL_LIST).groupBy("a").agg(F.count(F.lit(1)).alias("hot"), F.min("n").alias("n")))
    smallest = F.ceil(F.col("n") * percent / F.lit(100))
    crowded = durable(hot.where(F.col("hot") > spare_column(smallest, percent)).select("a"))

    short = listed.where(F.col("size") <= SMALL_LIST).select("key", "a", "n")
    met = short.join(short.withColumnsRenamed({"a": "b", "n": "m"}), "key").where((F.col("a") < F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    overlaps = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(spare_column(F.least("n", "m"), percent)).alias("spare"))
    of = lambda c: hot.select(F.col("a").alias(c), F.col("hot").alias(f"hot_{c}"))
    enough = lambda *c: F.col("shared") + F.least(*[F.coalesce(x, F.lit(0)) for x in c], F.lit(1 << 60)) > F.col("spare")
    pairs = overlaps.join(of("a"), "a", "left").where(enough("hot_a")).join(of("b"), "b", "left").where(enough("hot_a", "hot_b")).select("a", "b")

    # a crowded class's pivot: of the least classes of its hot lists, the one that it shares most of them with
    held = listed.where(F.col("size") > SMALL_LIST).select("key", "a").join(crowded, "a")
    least = held.groupBy("key").agg(F.min("a").alias("b"))
    shared = held.select("key", "a").join(least, "key").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    spokes = shared.where("a != b").groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    first = durable(likely(pairs.unionByName(_ordered(spokes, "a", "b")).distinct(), classes, percent))

    ids = first.select("a").unionByName(first.select(F.col("b").alias("a"))).unionByName(crowded.select("a")).distinct()
    sets = durable(whole_sets(docs, ids, width))

    # an id on several texts joins their classes
    of_set = classes.select("sid", F.col("a").alias("rep"))
    several = known.groupBy("doc_id").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x < y").select("doc_id")
    joined = known.select("doc_id", "sid").join(several, "doc_id", "left_semi").join(of_set, "sid").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = least_labels(confirmed(first, sets, percent).unionByName(joined))

    if not crowded.isEmpty():
        far = crowded_links(named(labels, crowded.select("a")), classes, sets, percent)
        ends = [labels.withColumnsRenamed({"node": c, "label": f"label_{c}"}) for c in ("a", "b")]
        between = far.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        beyond = least_labels(between).select(F.col("node").alias("label"), F.col("label").alias("least"))
        # a node that had no link before the last ones is not among labels
        every_node = labels.unionByName(beyond.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
        labels = every_node.join(beyond, "label", "left").select("node", F.coalesce("least", "label").alias("label"))

    of_rep = named(labels, of_set.withColumnRenamed("rep", "a")).select("sid", F.col("label").alias("_of"))
    out = every.select("doc_id", "n", "sid").join(of_rep, "sid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_of", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
