"""Benchmark decontamination by q-gram lemma filtering.

An item's segments start at every character of it.  A segment of n characters that occurs in a text with at most k edits
shares at least n - q + 1 - k q of its q-grams with the region, all on diagonals (text position less item position) that
lie within k of each other.  The index holds an item's q-grams once.  Shared ones are sorted in overlapping bands of
diagonals; only segments within which enough of a band's lie are kept, and a banded alignment verifies them.

The items are broadcast: their size is measured, and a benchmark over BLOCK_BYTES is searched for in blocks, one pass
over the documents each.  Documents never move: no shuffle, and a task holds one batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

Q, SEGMENT, EDIT_RATE = 12, 80, 0.06
#: Bands are twice this wide and overlap by half; it is at least the largest edit budget.
BAND = 16
SLOT_BITS = 22
BLOCK_BYTES = 16 << 20
#: Characters of texts looked at together.
CHUNK = 2_000_000
#: Segments aligned together.
ALIGNED = 512
#: No code point.
NOTHING = np.uint32(0xFFFFFFFF)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position, built by doubling; Q is 12 = 8 + 4."""
    if len(c) < Q:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h2 = c[:-1].astype(np.uint64) * _MUL + c[1:]
        h4 = h2[:-2] * _MUL * _MUL + h2[2:]
        h8 = h4[:-4] * np.uint64(0xD6E8FEB86659FD93) + h4[4:]
        h = h8[: len(c) - Q + 1] * np.uint64(0xA0761D6478BD642F) + h4[8 : 8 + len(c) - Q + 1]
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)


@dataclass
class Item:
    """Segments of an item have `length` characters, its own number if that is under SEGMENT.  The edit budget is
    EDIT_RATE of the length, less where the lemma would leave no bound; an item under Q has none."""

    points: np.ndarray
    length: int
    budget: int
    bound: int
    segments: int


def item_of(text: str) -> Item:
    n = min(len(text), SEGMENT)
    k = min(int(EDIT_RATE * n), (n - Q) // Q) if n >= Q else 0
    return Item(points(text), n, k, n - Q + 1 - k * Q, len(text) - n + 1)


def align(patterns: np.ndarray, windows: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least edit distance of the pattern to a stretch of the window, and where that ends; anchored:
    to one from its start."""
    at = np.arange(windows.shape[1] + 1)
    row = np.tile(at, (len(windows), 1)) if anchored else np.zeros((len(windows), len(at)), dtype=np.int64)
    for i in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != patterns[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - at, axis=1) + at
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def _stretches(c: np.ndarray, starts: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of width values of c from starts; NOTHING beyond its ends."""
    at = starts[:, None] + step * np.arange(width)
    return np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], NOTHING)


class Matcher:
    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = [item_of(t) for _, t in items]
        #: Items under Q; an item of white space is not searched for.
        self.tiny = [(n, t) for n, (_, t) in enumerate(items) if len(t) < Q and t.strip()]
        self.bound, self.span, self.last = (np.array(x, dtype=np.int64) for x in zip(*[(i.bound, i.length - Q, i.segments - 1) for i in self.items], strict=True))
        per = [gram_hashes(i.points) for i in self.items]
        codes = np.concatenate([*per, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(per)), [len(p) for p in per])
        pos = np.concatenate([np.arange(len(p)) for p in per] + [np.zeros(0, dtype=np.int64)])
        order = np.argsort(codes, kind="stable")
        self.codes, first, count = np.unique(codes[order], return_index=True, return_counts=True)
        self.first, self.count, self.item, self.pos = first, count, item[order], pos[order]
        self.slots = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.slots[(self.codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text, (item number, start, end, segments found) by item; offsets in code points, over all segments."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        part: list[int] = []
        size = 0
        for n, t in enumerate(texts):
            part.append(n)
            size += len(t or "")
            if size >= CHUNK:
                self._chunk(texts, part, out)
                part, size = [], 0
        self._chunk(texts, part, out)
        for n, t in enumerate(texts):
            if tiny := [(i, at, at + len(x), 1) for i, x in self.tiny if (at := (t or "").find(x)) >= 0]:
                out[n] = sorted(out[n] + tiny)
        return out

    def _chunk(self, texts: list[str | None], part: list[int], out: list) -> None:
        own = [texts[n] or "" for n in part]
        starts = np.cumsum([0] + [len(t) for t in own])
        c = points("".join(own))
        h = gram_hashes(c)
        near = np.flatnonzero(self.slots[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
        if not len(near) or not len(self.codes):
            return
        at = np.minimum(np.searchsorted(self.codes, h[near]), len(self.codes) - 1)
        hit = self.codes[at] == h[near]
        near, at = near[hit], at[hit]
        doc = np.searchsorted(starts, near, side="right") - 1
        inside = near + Q <= starts[doc + 1]
        near, at, doc = near[inside], at[inside], doc[inside]
        n = self.count[at]
        each = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, pos, doc = self.item[each], self.pos[each], np.repeat(doc, n)
        diagonal = np.repeat(near - starts[doc[np.cumsum(n) - n]] if len(n) else near, n) - pos
        band = diagonal // BAND + 8
        rows = np.unique(np.column_stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band + 1]), np.tile(pos, 2)]), axis=0)
        if not len(rows):
            return
        new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        first = np.flatnonzero(np.concatenate([[True], new]))
        group = np.concatenate([[0], np.cumsum(new)])
        # the last of the q-grams that reach the bound from each one on, if a segment holds them all
        i = np.arange(len(rows))
        j = i + self.bound[rows[:, 1]] - 1
        i, j = i[j < len(rows)], j[j < len(rows)]
        fits = (group[i] == group[j]) & (rows[j, 3] - rows[i, 3] <= self.span[rows[i, 1]])
        i, j = i[fits], j[fits]
        low, high = np.maximum(0, rows[j, 3] - self.span[rows[i, 1]]), np.minimum(rows[i, 3], self.last[rows[i, 1]])
        found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        cut = np.flatnonzero(np.diff(group[i])) + 1
        for at in sorted(np.split(np.arange(len(i)), cut), key=lambda at: -len(at)) if len(i) else []:
            d, n, b = (int(x) for x in rows[first[group[i[at[0]]]], :3])
            spans = found.setdefault((d, n), {})
            asked = np.unique(np.concatenate([np.arange(low[x], high[x] + 1) for x in at]))
            asked = np.array([x for x in asked.tolist() if x not in spans], dtype=np.int64)
            for x in range(0, len(asked), ALIGNED):
                spans |= self._verify(c[starts[d] : starts[d + 1]], n, asked[x : x + ALIGNED], (b - 9) * BAND)
        for (d, n), spans in sorted(found.items()):
            if spans:
                out[part[d]].append((n, min(a for a, _ in spans.values()), max(b for _, b in spans.values()), len(spans)))

    def _verify(self, text: np.ndarray, n: int, segments: np.ndarray, low: int) -> dict[int, tuple[int, int]]:
        """Start of a segment -> its place in the text, for those of an item that occur on the band from low."""
        item = self.items[n]
        k = item.budget
        patterns = _stretches(item.points, segments, item.length)
        begin = np.maximum(0, segments + low - k)
        edits, end = align(patterns, _stretches(text, begin, 2 * BAND + item.length + 2 * k))
        good = edits <= k
        patterns, stop = patterns[good], begin[good] + end[good]
        # backwards from the end, over what the budget leaves
        length = align(patterns[:, ::-1], _stretches(text, stop - 1, item.length + k, -1), anchored=True)[1] if len(stop) else stop
        return {int(s): (int(e - x), int(e)) for s, e, x in zip(segments[good], stop, length, strict=True)}


def matchers(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Matcher]:
    """One matcher for each block of items; none for a benchmark without texts.  Only a block is ever on the driver."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        if rows := part.collect():
            yield Matcher(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0], x[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end, n_segments, segments: a row for each document row and item of which a segment was
    found; nothing for the others.

    Null and empty texts hold nothing; items without a text or of white space are not searched for, and those under Q
    characters count where they occur as they are.  Repeated documents, and repeated items, give rows of their own.  Other columns are not read."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, start long, end long, n_segments int, segments int"
    out = spark.createDataFrame([], schema)
    for m in matchers(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(m)

        def run(batches: Iterator, shared=shared) -> Iterator:
            m = shared.value
            total = [i.segments for i in m.items]
            for pdf in batches:
                release()
                hits = [(d, *hit) for d, found in zip(pdf["doc_id"], m.find(pdf["text"].tolist()), strict=True) for hit in found]
                yield pd.DataFrame({"doc_id": [h[0] for h in hits], "item_id": [m.ids[h[1]] for h in hits], "start": [h[2] for h in hits], "end": [h[3] for h in hits], "n_segments": [h[4] for h in hits], "segments": [total[h[1]] for h in hits]})

        out = out.unionByName(rows.mapInPandas(run, schema))
    return out


def is_leaked(benchmark: DataFrame, text: Column) -> Column:
    """Whether a text holds a segment of any item."""

    def holder(shared):
        def holds(texts: pd.Series) -> pd.Series:
            release()
            return pd.Series([bool(x) for x in shared.value.find(texts.tolist())], dtype=bool)

        return F.pandas_udf(holds, "boolean")

    flag = F.lit(False)
    for m in matchers(benchmark):
        flag = flag | holder(benchmark.sparkSession.sparkContext.broadcast(m))(text)
    return flag
