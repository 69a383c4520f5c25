"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Each adjacent pair that the
vocabulary can merge waits in the bucket of its rank; three levels of bitmaps
say which buckets hold something, and find-first-set on them gives the lowest
rank. Entries whose pair has changed since are skipped as they come up. Work is
O(n log n) in the length of the pre-token, so very long ones do not stall.

Defined results: null text counts as empty (no ids); texts are taken whole;
special tokens are ordinary text. Rows pass through one by one, so repeated
rows repeat and empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokens that each worker keeps with their ids, twice over at most, and the longest of those.
#: A pre-token takes 64 characters of four bytes and as many ids and 150 bytes of objects at most: 270 MB
#: in all at worst, and about 100 MB for words of usual length.
CACHED, CACHED_CHARS = 200_000, 64
#: Pre-tokens of a text handled at once.
CHUNK = 200_000


_BIT = tuple(1 << k for k in range(64))


class RankQueue:
    """Positions by rank; pop() gives the lowest rank's leftmost position.

    low has a bit a rank, mid one for each word of low, top one for each word of
    mid. A drained queue is as new, so one queue serves many pre-tokens.
    """

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, at)
            return
        bucket.append(at)
        word = rank >> 6
        if not self.low[word]:
            self.mid[word >> 6] |= _BIT[word & 63]
            self.top |= 1 << (word >> 6)
        self.low[word] |= _BIT[rank & 63]

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        bits = self.mid[a]
        word = (a << 6) + (bits & -bits).bit_length() - 1
        low = self.low[word]
        rank = (word << 6) + (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        low &= low - 1
        self.low[word] = low
        if not low:
            bits &= bits - 1
            self.mid[a] = bits
            if not bits:
                self.top = top & (top - 1)
        return rank, bucket.pop()


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token: always the lowest-ranked, leftmost pair merges."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of, push, pop = ranks.get, queue.push, queue.pop
    waiting = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
    waiting.append(-1)
    for i, rank in enumerate(waiting):
        if rank >= 0:
            push(rank, i)
    while entry := pop():
        rank, i = entry
        if waiting[i] != rank:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        waiting[gone] = -1
        if end < n:
            before[end] = i
            rank = waiting[i] = rank_of(piece[i : after[end]], -1)
            if rank >= 0:
                push(rank, i)
        else:
            waiting[i] = -1
        left = before[i]
        if left >= 0:
            rank = waiting[left] = rank_of(piece[left:end], -1)
            if rank >= 0:
                push(rank, left)
    ids, i = [], 0
    while i < n:
        end = after[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return ids


class _Packed(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, made when missing.

    A full cache becomes the older one, from which what is used again comes back.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("I", merge(piece.encode("utf-8", "surrogatepass"), self.ranks, self.queue)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        self.ranks = parse_ranks(raw)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.packed = _Packed(self.ranks)

    def chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text, packed, a bounded number of pre-tokens at once."""
        if len(text) <= CHUNK:
            yield b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))
            return
        found = self.pattern.finditer(text)
        while pieces := [m.group() for m in islice(found, CHUNK)]:
            yield b"".join(map(self.packed.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in self.chunks(text or "") for i in array("I", chunk)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[bytes, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _read_vocabulary(df: DataFrame, path: str):
    """The rank file is read once here and sent along: it is of a fixed size, about 1 MB."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and the ids of the text as an array, which replaces a column of that name."""
    docs = docs.drop(ids)
    raw = _read_vocabulary(docs, path)

    def run(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            made = pa.array([codec.encode(t) for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, ids])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, `{ids}` array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """All columns and the bytes that the ids stand for, which replace a column of that name; null ids give null."""
    encoded = encoded.drop(out)
    raw = _read_vocabulary(encoded, path)

    def run(batches):
        codec = _codec(raw.value, "")
        for batch in batches:
            made = pa.array([None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, `{out}` binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. A doc_id of any type is kept as it is.

    Encodes, then decodes the ids, in one pass: the ids never leave the worker.
    """
    raw = _read_vocabulary(docs, path)

    def digest(codec: Codec, text: str | None) -> tuple[int, str, str]:
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for chunk in codec.chunks(text or ""):
            n += len(chunk) // 4
            ids.update(chunk)
            decoded.update(codec.decode(array("I", chunk)))
        return n, ids.hexdigest(), decoded.hexdigest()

    def run(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            made = [digest(codec, t.as_py()) for t in batch.column(1)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
