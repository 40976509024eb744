"""Repeated byte strings across documents, by a distributed difference-cover sort of suffixes cut off at depth LENGTH.

Positions whose remainder modulo PERIOD is in COVER are sampled.  COVER holds every difference modulo PERIOD, so two
equal strings of LENGTH bytes, wherever they start, have sampled positions at an equal offset below PERIOD, and at each
of these the same tuple of GRAM = LENGTH - PERIOD + 1 bytes.  The steps:

1. sort the sampled tuples into names.  A name that one document alone holds is discarded with its suffixes;
2. recurse on names: a unit is the triple of names at i - PERIOD, i and i + PERIOD, which together cover every string that
   the sampled position i stands for (starts from i - PERIOD + 1 to i).  Units are sorted and named in the same way;
3. merge the remaining suffixes: strings whose names agree while their units differ are sorted one by one;
4. equal neighbours in the sorted order are compared by their documents: all but the smallest one's are repeats.

Documents are put into chunks in the order of their ids.  A chunk sends its sorted distinct names, once each, to the
ranges of the sorted order, as differences of neighbours; a range answers each chunk in its own order.  So a name
that a third of all documents hold is one entry a chunk, and texts are moved once.  Names in step 1 are cut to
SPARE_BITS beyond the number of samples, which only discards less.  Units and strings are compared by 96 bits of
independent hashes of all of their bytes; bytes themselves are not moved (n distinct strings collide with
probability n * n / 2 ** 97).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable

LENGTH = 50
#: A perfect difference set, every remainder but 0 is the difference of one pair.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
GRAM = LENGTH - PERIOD + 1
#: Bits of a name in step 1 beyond the logarithm of the number of samples.
SPARE_BITS = 6
#: Least bytes of text in a chunk, and entries that a chunk and a range have in common on average in larger inputs.
CHUNK, MEETING = 4 << 20, 300
_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407], dtype=np.uint64)
MOST = (1 << 15) - 1
#: Positions that are hashed at a time.
SLICE = 1 << 15


def _hash(parts: list[np.ndarray], seed: np.uint64) -> np.ndarray:
    """A hash of the sequence of parts, for each element; parts that differ in one place never have one hash."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), seed, dtype=np.uint64)
        odd = _A ^ seed | np.uint64(1)  # an even factor would lose the top bit of each part
        for p in parts:
            t = p * odd
            t ^= t >> np.uint64(32)
            h += t
            h *= _M
            h ^= h >> np.uint64(29)
        h *= _B
        h ^= h >> np.uint64(32)
    return h


def _bytes_at(data: bytes, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The size bytes from each position, as 64-bit words that cover them."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return [words[at + k] for k in (*range(0, size - 8, 8), size - 8)]


def _hashes_at(data: bytes, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Two hashes of the size bytes from each position, made a slice of positions at a time."""
    out = [np.empty(len(at), dtype=np.uint64) for _ in _SEEDS]
    for k in range(0, len(at), SLICE):
        parts = _bytes_at(data, at[k : k + SLICE], size)
        for made, seed in zip(out, _SEEDS, strict=True):
            made[k : k + SLICE] = _hash(parts, seed)
    return out


def _squeeze(values: np.ndarray) -> bytes:
    """Integers by planes of their bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _spread(held: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize).T).reshape(-1).view(kind)


def _sorted(a: np.ndarray, b: np.ndarray | None, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys (a, b), a below 2 ** width, and where in it a new key begins."""
    places = max(1, len(a) - 1).bit_length()
    if width + places <= 64:
        packed = np.sort(a << np.uint64(places) | np.arange(len(a), dtype=np.uint64))
        order, x = (packed & np.uint64((1 << places) - 1)).astype(np.int64), packed >> np.uint64(places)
    else:
        order = np.argsort(a, kind="stable")
        x = a[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    if b is not None:
        y = b[order]
        if (~new[1:] & (y[1:] != y[:-1])).any():
            order = np.lexsort((b, a))
            x, y = a[order], b[order]
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


class Entries:
    """The distinct keys (a, b) of a chunk in sorted order; at: the entry of each given key; first: the rank of the
    first document that holds an entry; several: whether several documents do.  Ranks are given in ascending order."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, rank: np.ndarray, width: int = 64):
        order, new = _sorted(a, b, width)
        start = np.flatnonzero(new)
        lead = order[start]
        self.a, self.b = a[lead], None if b is None else b[lead]
        self.at = np.empty(len(a), dtype=np.int32)
        self.at[order] = np.cumsum(new) - 1
        self.first = rank[lead]
        self.several = rank[order[np.append(start[1:], len(a)) - 1]] > self.first if len(a) else np.zeros(0, dtype=bool)

    def requests(self, bits: int, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, keys a, keys b) for ranges of the first of `bits` bits."""
        low = [(r << bits) // ranges for r in range(ranges)]
        cut = np.append(np.searchsorted(self.a, np.array(low, dtype=np.uint64)), len(self.a))
        for r in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            a = self.a[cut[r] : cut[r + 1]]
            yield r, _squeeze(np.diff(a, prepend=np.uint64(0))), b"" if self.b is None else _squeeze(self.b[cut[r] : cut[r + 1]])


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each request of a range: for each of its keys twice the number of chunks that hold it, up to MOST, plus one
    if none of these comes before the request's own chunk.  What a chunk notes for itself (a range below 0) passes."""
    if pdf["range"].iat[0] < 0:
        return pd.DataFrame({"chunk": pdf["chunk"], "range": -1, "said": pdf["a"]})
    pdf = pdf.sort_values("place")
    a, b, sizes = [], [], []
    for ka, kb in zip(pdf["a"], pdf["b"], strict=True):
        a.append(np.cumsum(_spread(ka, "<u8"), dtype=np.uint64))
        sizes.append(len(a[-1]))
        b.append(_spread(kb, "<u4") if kb else None)
    both = None if b[0] is None else np.concatenate(b)
    order, new = _sorted(np.concatenate(a), both)
    place = np.repeat(pdf["place"].to_numpy(), sizes)[order]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    held = np.minimum(np.diff(np.append(start, len(order))), MOST)
    said = np.empty(len(order), dtype=np.uint16)
    said[order] = held[group] * 2 + (place == place[start][group])
    return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "said": [_squeeze(x) for x in np.split(said, np.cumsum(sizes)[:-1])]})


def _noted(**arrays: np.ndarray) -> bytes:
    """Arrays that a chunk notes for its next step; starts are kept as differences."""
    import pickle

    return pickle.dumps({k: (str(v.dtype), _squeeze(np.diff(v, prepend=v.dtype.type(0)) if k == "start" else v)) for k, v in arrays.items()})


def _recalled(noted: bytes) -> dict[str, np.ndarray]:
    import pickle

    out = {k: _spread(v, kind) for k, (kind, v) in pickle.loads(noted).items()}
    return out | {"start": np.cumsum(out["start"], dtype=np.int64)}


class Chunk:
    """The texts of a chunk, one after the other, and what the ranges said of its last step."""

    def __init__(self, row, bits: int, said: list[tuple[int, bytes]]):
        import zstandard

        self.size = np.asarray(row["sizes"], dtype=np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(self.size.sum()) or 1)
        self.begin = np.cumsum(self.size) - self.size
        self.rank, self.bits = np.asarray(row["ranks"]), bits
        said = sorted(said)
        self.note = _recalled(said.pop(0)[1]) if said and said[0][0] < 0 else None
        self.said = np.concatenate([np.zeros(0, dtype=np.uint16), *(_spread(x, "<u2") for _, x in said)])

    def names(self) -> tuple[Entries, bytes | None]:
        """Step 1: names of all sampled positions."""
        least = self.size - GRAM + 1
        at = [(np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).reshape(-1) for n in least.tolist()]
        at = [p[: np.searchsorted(p, n)] for p, n in zip(at, least.tolist(), strict=True)]
        count = np.array([len(p) for p in at])
        self.begun = np.append(0, np.cumsum(count))
        self.of = np.repeat(np.arange(len(at)), count)
        self.at = np.concatenate(at)
        self.name = _hashes_at(self.raw, self.at + self.begin[self.of], GRAM)
        return Entries(self.name[0] >> np.uint64(64 - self.bits), None, self.rank[self.of], self.bits), None

    def units(self) -> tuple[Entries, bytes]:
        """Step 2: units of the sampled positions whose names several documents hold."""
        e, _ = self.names()
        held = self.said >> 1
        kept = np.flatnonzero(((held > 1) | e.several)[e.at])
        of, at = self.of[kept], self.at[kept]
        low, high = self._starts(of, at)
        kept, of, at = kept[high >= low], of[high >= low], at[high >= low]
        step = len(COVER)
        before, after = kept - step >= self.begun[of], kept + step < self.begun[of + 1]
        both = []
        for seed, name in zip(_SEEDS, self.name, strict=True):
            left, right = name[np.where(before, kept - step, 0)], name[np.where(after, kept + step, 0)]
            for has, side, cut in ((before, left, 0), (after, right, 1)):
                # where a text ends within the unit, the bytes up to its end stand for the name
                for i in np.flatnonzero(~has).tolist():
                    begin, p = int(self.begin[of[i]]), int(at[i])
                    p, end = (p + GRAM, min(p + LENGTH + 1, int(self.size[of[i]]))) if cut else (max(0, p - PERIOD), p)
                    side[i] = int.from_bytes(hashlib.blake2b(self.raw[begin + p : begin + end], digest_size=8, salt=int(seed).to_bytes(8, "big")).digest(), "big")
            both.append(_hash([left, name[kept], right], seed))
        units = Entries(both[0], (both[1] >> np.uint64(32)).astype(np.uint32), self.rank[of])
        # a name has several units if fewer chunks hold one of them than hold the name, or a chunk has two of them
        name = e.at[kept]
        some = np.zeros(len(held), dtype=np.int32)
        some[name] = units.at
        torn = np.zeros(len(held), dtype=bool)
        torn[name[some[name] != units.at]] = True
        flags = torn[name] + 2 * (self.rank[of] == units.first[units.at])
        return units, _noted(start=at + self.begin[of], entry=units.at, held=held[name], flags=flags.astype(np.uint8))

    def _starts(self, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings that positions stand for."""
        return np.maximum(at - PERIOD + 1, 0), np.minimum(at, self.size[of] - LENGTH)

    def _within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each byte of the chunk is in any [low, high).  Neither low nor high descends."""
        edge = np.zeros(len(self.raw) + 1, dtype=np.int8)
        if len(low):
            apart = np.flatnonzero(low[1:] > high[:-1])
            edge[low[np.append(0, apart + 1)]] = 1
            edge[high[np.append(apart, len(low) - 1)]] = -1
        return np.cumsum(edge[:-1], dtype=np.int8).view(bool)

    def strings(self) -> tuple[Entries, bytes]:
        """Step 3: strings of units that come first while their names have other units too."""
        note = self.note
        of = np.searchsorted(self.begin, note["start"], side="right") - 1
        low, high = (x + self.begin[of] for x in self._starts(of, note["start"] - self.begin[of]))
        held, leads = (self.said >> 1)[note["entry"]], (self.said & 1).astype(bool)[note["entry"]]
        torn, local = note["flags"] & 1 > 0, note["flags"] & 2 > 0
        later = ~(leads & local)
        gone = self._within(low[later], high[later] + LENGTH)
        # Where every chunk that holds a name holds one unit, only the chunks that hold others too open it.  There, the
        # strings of a unit that an earlier chunk holds are known repeats, and so are strings equal to them.
        open_ = local & (torn | leads & ((held != note["held"]) | (held == MOST)))
        at = np.flatnonzero(self._within(low[open_], high[open_] + 1))
        known = self._within(low[open_ & ~leads], high[open_ & ~leads] + 1)[at]
        rank = self.rank[np.searchsorted(self.begin, at, side="right") - 1]
        one, two = _hashes_at(self.raw, at, LENGTH)
        strings = Entries(one, (two >> np.uint64(32)).astype(np.uint32), rank)
        local = rank == strings.first[strings.at]
        return strings, _noted(start=at, entry=strings.at, flags=(known + 2 * local).astype(np.uint8), gone=np.packbits(gone))

    def repeats(self) -> list[list[tuple[int, int]]]:
        """Step 4: for each text its maximal runs of bytes covered by repeats."""
        note = self.note
        known = np.zeros(len(self.said), dtype=bool)
        known[note["entry"][note["flags"] & 1 > 0]] = True
        later = ~((self.said & 1).astype(bool)[note["entry"]] & (note["flags"] & 2 > 0)) | known[note["entry"]]
        at = note["start"][later]
        gone = self._within(at, at + LENGTH) | np.unpackbits(note["gone"], count=len(self.raw)).astype(bool)
        return [_runs(gone[a : a + n]) for a, n in zip(self.begin.tolist(), self.size.tolist(), strict=True)]


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """chunk, place, ids, ranks, sizes, data: texts of about size bytes in the order of their ids.  The rows of one id
    share a chunk's place in that order, however many chunks they fill."""

    def pack(batches: Iterator) -> Iterator:
        import zstandard
        from pyspark import TaskContext

        base, made, held, held_size, place = TaskContext.get().partitionId() << 32, 0, [], 0, None

        def flush(rows, place):
            nonlocal made
            ids, texts = [r[0] for r in rows], [r[1] for r in rows]
            ranks = np.cumsum([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))]).tolist()
            chunk, made = base + made, made + 1
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pd.DataFrame({"chunk": [chunk], "place": [chunk if place is None else place], "ids": [ids], "ranks": [ranks], "sizes": [[len(t) for t in texts]], "data": [data]}), chunk

        for pdf in batches:
            for i, data in zip(pdf["doc_id"], pdf["text"], strict=True):
                if place is not None and i != last:  # what an id has in a place of its own stays alone
                    if held:
                        yield flush(held, place)[0]
                    held, held_size, place = [], 0, None
                elif held and held_size >= size:
                    if held[0][0] == held[-1][0] == i:  # an id that fills a chunk by itself goes on in the same place
                        out, chunk = flush(held, place)
                        place = chunk if place is None else place
                        held, held_size = [], 0
                        yield out
                    elif held[-1][0] != i:
                        yield flush(held, place)[0]
                        held, held_size = [], 0
                    else:  # the last id has chunks of its own from here
                        at = next(k for k, r in enumerate(held) if r[0] == i)
                        yield flush(held[:at], place)[0]
                        held = held[at:]
                        held_size = sum(len(r[1]) for r in held)
                held.append((i, data))
                held_size, last = held_size + len(data), i
        if held:
            yield flush(held, place)[0]

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInPandas(pack, f"chunk long, place long, ids array<{kind}>, ranks array<int>, sizes array<int>, data binary")


ASKED = "chunk long, place long, range long, a binary, b binary"
SAID = "chunk long, range long, said binary"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _judged(doc_id, data: bytes, runs: list, with_text: bool) -> tuple:
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    left = b"".join([*kept, data[at:]])
    return doc_id, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), *[left] * with_text


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary); one row per input row.

    A null text counts as empty, and bytes that are no UTF-8 count as they are.  A row with a null id is neither searched nor a source and stays as it is; rows that
    share an id are no sources for each other, and each is judged on its own text.  Equality is by 96 bits of hashes
    (see above).  A text is held whole by one task, with some 20 bytes a byte of it."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    searched = F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    total = rows.where(searched).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    samples = max(1, total * len(COVER) // PERIOD)
    bits = min(64, math.ceil(math.log2(samples)) + SPARE_BITS)
    size = max(CHUNK, int(math.sqrt(samples * MEETING) * PERIOD / len(COVER)))
    ranges = max(1, min(1 << 20, samples // max(MEETING, size * len(COVER) // PERIOD // 4)))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = durable(_chunks(rows.where(searched), size).repartition(parts, "chunk"), dealt=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def asked(row: pd.DataFrame, entries: Entries, note: bytes | None, width: int) -> pd.DataFrame:
        chunk = int(row["chunk"].iat[0])
        out = [(chunk, row["place"].iat[0], *x) for x in entries.requests(width, ranges)]
        if note is not None:
            out.append((chunk, chunk, -1 - chunk, note, b""))
        return pd.DataFrame(out, columns=["chunk", "place", "range", "a", "b"])

    def name(batches: Iterator) -> Iterator:
        for pdf in batches:
            for k in range(len(pdf)):
                row = pdf.iloc[k : k + 1]
                yield asked(row, *Chunk(row.iloc[0], bits, []).names(), bits)

    def told(row: pd.DataFrame, said: pd.DataFrame) -> Chunk:
        return Chunk(row.iloc[0], bits, list(zip(said["range"], said["said"], strict=True)))

    def next_step(step: str):
        return lambda row, said: asked(row, *getattr(told(row, said), step)(), 64)

    def judge(row: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        chunk = told(row, said)
        texts = [chunk.raw[a : a + n] for a, n in zip(chunk.begin.tolist(), chunk.size.tolist(), strict=True)]
        out = [_judged(i, t, runs, with_text) for i, t, runs in zip(row["ids"].iat[0], texts, chunk.repeats(), strict=True)]
        return pd.DataFrame(out, columns=COLUMNS + ["kept"] * with_text)

    def answered(requests: DataFrame) -> DataFrame:
        return durable(requests.groupBy("range").applyInPandas(answer, SAID).coalesce(min(parts, ranges)))

    # every step works from the chunks and the last answers
    said = answered(chunks.mapInPandas(name, ASKED))
    for step in ("units", "strings"):
        said = answered(chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(next_step(step), ASKED))
    found = chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(judge, result)

    untouched = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").alias("kept")] * with_text]
    return found.unionByName(rows.where(~searched).select("doc_id", *untouched))
