"""Byte-level BPE by prefix dynamic programming.

For a piece of n bytes the encoder keeps, for each prefix, the last token of that prefix's encoding.  It is unique:
token t can end prefix i only if the token that ends prefix i - len(t) and t stay two tokens when their joined bytes
are encoded.  Reading the table backwards gives any prefix's encoding, appending extends the table in place, and
after an edit only entries behind it are computed again.

Texts are cut into pieces by the tokenizer's pattern; each piece is encoded on its own and the ids of frequent pieces
are remembered in a bounded table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

#: Pieces, and token pairs and steps between states, remembered by a worker.  Beyond that its table starts afresh: memory stays bounded, results
#: don't change.
REMEMBERED, PAIRS = 600_000, 1_000_000
#: A piece of more bytes is encoded but not remembered.
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_encode(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Plain BPE: join the lowest-ranked neighbours until none can be joined.  Defines which token pairs are valid."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class PrefixTable:
    """The tokens that end each prefix of a growing, editable byte string."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b"") -> None:
        self.bpe, self.data, self.last, self.states = bpe, bytearray(), [0], [0]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        last, states, bpe = self.last, self.states, self.bpe
        step, ends, known, bits = bpe.steps.get, bpe.ends, bpe.valid.get, bpe.bits
        state = states[-1]
        for end, byte in enumerate(more, len(last)):
            if (then := step(state << 8 | byte)) is None:
                then = bpe.advance(state, byte)
            state = then
            for rank, n in ends[state]:
                if n == end:
                    break
                before = last[end - n]
                if (ok := known(before << bits | rank)) is None:
                    ok = bpe.joins(before, rank)
                if ok:
                    break
            else:
                raise ValueError(f"byte {byte} is in no token")
            last.append(rank)
            states.append(state)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Puts new in place of data[start:end].  The table's first start + 1 entries stay."""
        tail = bytes(self.data[end:])
        del self.data[start:], self.last[start + 1 :], self.states[start + 1 :]
        return self.append(new + tail)

    def ids(self, end: int | None = None) -> list[int]:
        at, out, last, bytes_of = len(self.data) if end is None else end, [], self.last, self.bpe.bytes_of
        while at:
            out.append(rank := last[at])
            at -= len(bytes_of[rank])
        return out[::-1]


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.bits = max(self.bytes_of, default=0).bit_length()
        #: A state is the longest end of what was read that starts a token; state 0 is the empty one.
        self.starts = [b"", *{t[:i] for t in ranks for i in range(1, len(t) + 1)}]
        self.state_of = {s: i for i, s in enumerate(self.starts)}
        #: By state, the tokens that end it (rank, bytes), longest first; known of states that were reached.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.starts)
        self.steps: dict[int, int] = {}
        self.valid: dict[int, bool] = {}
        self.known: dict[str, str] = {}
        self.bytes_of_text = {str(r): t for r, t in self.bytes_of.items()}

    def advance(self, state: int, byte: int) -> int:
        """The state behind state and byte."""
        if len(self.steps) >= PAIRS:
            self.steps.clear()
        end = self.starts[state] + bytes([byte])
        while end not in self.state_of:
            end = end[1:]
        then = self.steps[state << 8 | byte] = self.state_of[end]
        if not self.ends[then]:
            self.ends[then] = tuple((self.ranks[end[i:]], len(end) - i) for i in range(len(end)) if end[i:] in self.ranks)
        return then

    def joins(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two tokens: no step of plain BPE on their joined bytes crosses between them."""
        if len(self.valid) >= PAIRS:
            self.valid.clear()
        found = self.valid[a << self.bits | b] = self._apart(self.bytes_of[a], self.bytes_of[b])
        return found

    def _apart(self, a: bytes, b: bytes) -> bool:
        get, both, border = self.ranks.get, a + b, len(a)
        if both in self.ranks:
            return False
        cuts = list(range(len(both) + 1))  # parts are both[cuts[i]:cuts[i + 1]]
        cost = [get(both[i : i + 2]) for i in range(len(both) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(cost):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or cuts[at + 1] == border:
                return best is None and border in cuts
            del cuts[at + 1], cost[at]
            if at < len(cost):
                cost[at] = get(both[cuts[at] : cuts[at + 2]])
            if at:
                cost[at - 1] = get(both[cuts[at - 1] : cuts[at + 1]])

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        return [self.ranks[data]] if data in self.ranks else PrefixTable(self, data).ids()

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.piece(p)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _learn(self, piece: str) -> str:
        ids = " ".join(map(str, self.piece(piece)))
        if len(piece) <= LONG_PIECE:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def digest(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, their decimals joined by a space, and the bytes that they decode to."""
        known, learn = self.known.get, self._learn
        ids = " ".join([known(p) or learn(p) for p in self.pattern.findall(text)])
        each = ids.split()
        return len(each), ids, b"".join(map(self.bytes_of_text.__getitem__, each))


@functools.lru_cache(maxsize=1)
def loaded(path: str, pattern: str) -> PrefixBpe:
    """A worker's encoder: later tasks find its vocabulary, steps and token pairs.  Pieces are each task's own."""
    return PrefixBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (decimals joined by one space); a row per row.

    A null text counts as empty: no tokens, the hashes of nothing.  Repeated rows are encoded each on their own.
    Every worker reads the vocabulary from path, a file that all machines have."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = loaded(path, pattern)
        bpe.known.clear()
        for batch in batches:
            release()
            n, ids_of, ids_sha, decoded_sha = [], [], [], []
            for t in batch.column(len(keep)):
                count, ids, decoded = bpe.digest(t.as_py() or "")
                n.append(count)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_of.append(ids)
            arrays = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids_of, pa.string())] * with_ids, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        bpe.known.clear()
        release()

    bounded_batches(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * with_ids
    return narrow.mapInArrow(run, schema)
