"""Byte-level BPE by two-tier lookup.

A pre-token that the vocabulary holds whole is resolved by a minimal perfect
hash over the vocabulary. Any other is split into bytes in a linked list, whose
pairs wait in a heap by rank; the lowest rank, leftmost first, is merged until
no pair is in the vocabulary. Which ids join to which id is looked up once per
worker, and a worker keeps the pre-tokens it has met from task to task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import type_of

KEYS_PER_BUCKET = 4
MIX = 0x9E3779B97F4A7C15
SCATTER = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
PRIME = (1 << 61) - 1
#: Pre-tokens in either generation of those that a worker remembers.
REMEMBERED = 250_000
#: Longest pre-tokens remembered, in characters; longer ones seldom come again.
LONGEST = 64
#: Bits of a place in a heap entry.
HALF = 32
#: What an id that no other can follow is joined with.
NOTHING: dict[int, int] = {}
ROWS_PER_BATCH = 256


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, no gap.

    Keys fall into buckets; from the fullest bucket on, each looks for a
    displacement that sends its keys to free slots. A bucket of one key names
    its slot outright, as a negative number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.size = len(keys)
        self.buckets = max(1, -(-self.size // KEYS_PER_BUCKET))
        members: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            number = self.number(key)
            members.setdefault(number % self.buckets, []).append((number, i))
        shifts = np.zeros(self.buckets, np.int64)
        free = np.ones(self.size, bool)
        order = np.full(self.size, -1, np.int64)
        singles = []
        for bucket, group in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(group) == 1:
                singles.append((bucket, group[0][1]))
                continue
            numbers = np.array([n for n, _ in group], np.uint64)
            start = 0
            while True:
                tried = np.arange(start, start + 256, dtype=np.uint64)
                slots = self._slots(numbers[None, :], tried[:, None])
                good = free[slots].all(axis=1)
                for row in np.flatnonzero(good):
                    if len(set(slots[row].tolist())) == len(group):
                        break
                else:
                    start += 256
                    continue
                break
            shifts[bucket] = start + row
            free[slots[row]] = False
            order[slots[row]] = [i for _, i in group]
        for (bucket, i), slot in zip(singles, np.flatnonzero(free).tolist()):
            shifts[bucket] = -slot - 1
            order[slot] = i
        self.shifts = shifts.tolist()
        #: Position of each slot's key in ``keys``.
        self.order = order.tolist()

    def number(self, key: bytes) -> int:
        return (int.from_bytes(key, "little") * 257 + len(key)) % PRIME

    def _slots(self, numbers: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (numbers ^ (shift * np.uint64(MIX))) * np.uint64(SCATTER)
        return ((mixed >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """The slot of a key; any slot for what is no key."""
        number = (int.from_bytes(key, "little") * 257 + len(key)) % PRIME
        shift = self.shifts[number % self.buckets]
        if shift < 0:
            return -shift - 1
        return ((((number ^ shift * MIX & MASK) * SCATTER) & MASK) >> 32) % self.size


class Codec:
    """Encoder and decoder over (bytes, rank) pairs, all 256 single bytes included."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if len(ranks) == 0 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        keys = list(ranks)
        self.pattern = pattern
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.order]
        self.ranks = [ranks[k] for k in self.keys]
        self.longest = max(map(len, keys))
        #: Ids of the single bytes.
        self.single = [ranks[bytes([b])] for b in range(256)]
        whole = repr((pattern, self.keys, self.ranks)).encode()
        self.digest = hashlib.sha256(whole).hexdigest()

    @cached_property
    def joined(self) -> dict[int, dict[int, int]]:
        """By two ids, that of their joined bytes, for all pairs that the vocabulary joins."""
        found: dict[int, dict[int, int]] = {rank: {} for rank in self.ranks}
        for key, rank in zip(self.keys, self.ranks):
            for cut in range(1, len(key)):
                left = self.rank(key[:cut])
                right = None if left is None else self.rank(key[cut:])
                if right is not None:
                    found[left][right] = rank
        return {left: rights or NOTHING for left, rights in found.items()}

    @cached_property
    def first(self) -> dict[tuple[int, int], int]:
        """Id of two bytes, for those that the vocabulary joins."""
        pairs = ((k, r) for k, r in zip(self.keys, self.ranks) if len(k) == 2)
        return {(key[0], key[1]): rank for key, rank in pairs}

    def rank(self, piece: bytes) -> int | None:
        if len(piece) > self.longest:
            return None
        slot = self.hash.slot(piece)
        return self.ranks[slot] if self.keys[slot] == piece else None

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank(piece)
        return [whole] if whole is not None else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        n, joined = len(piece), self.joined
        own = list(map(self.single.__getitem__, piece))
        # Id of each part joined with the next one, if there is such an id.
        pairs = list(map(self.first.get, zip(piece, piece[1:])))
        # A heap entry is the id and the place of a pair in one number.
        heap = [rank << HALF | i for i, rank in enumerate(pairs) if rank is not None]
        if not heap:
            return own
        heapify(heap)
        pairs.append(None)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            entry = heap[0]
            i, rank = entry & 0xFFFFFFFF, entry >> HALF
            # Stale: the left part is gone, or either has grown, whose bytes have another id.
            if pairs[i] != rank:
                heappop(heap)
                continue
            middle = end[i]
            stop = end[middle]
            own[i], end[i] = rank, stop
            own[middle] = pairs[middle] = None
            if stop < n:
                before[stop] = i
                pairs[i] = wider = joined[rank].get(own[stop])
            else:
                pairs[i] = wider = None
            if wider is None:
                heappop(heap)
            else:
                heapreplace(heap, wider << HALF | i)
            left = before[i]
            if left >= 0:
                pairs[left] = wider = joined[own[left]].get(rank)
                if wider is not None:
                    heappush(heap, wider << HALF | left)
        return [found for found in own if found is not None]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for found in regex.findall(self.pattern, text):
            ids += self.piece(found.encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        known = dict(zip(self.ranks, self.keys))
        return b"".join(known[i] for i in ids)


class _Bytes:
    """Bytes of all ids on end, to decode a whole array of ids at once."""

    def __init__(self, codec: Codec) -> None:
        self.held = np.frombuffer(b"".join(codec.keys), np.uint8)
        sizes = np.array(list(map(len, codec.keys)))
        self.sizes = np.zeros(max(codec.ranks) + 1, np.int64)
        self.sizes[codec.ranks] = sizes
        self.starts = np.zeros_like(self.sizes)
        self.starts[codec.ranks] = np.cumsum(sizes) - sizes

    def of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        # Distance from a byte's place in the text to its place among those held.
        ahead = self.starts[ids] - np.cumsum(sizes) + sizes
        places = np.repeat(ahead, sizes)
        places += np.arange(len(places))
        return self.held[places].tobytes()


class _Remembered(dict):
    """Ids of pre-tokens as texts, by pre-token, in two generations.

    When the younger is full it takes the place of the older, from which what
    comes again is taken over.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.older: dict[str, str] = {}

    def __missing__(self, found: str) -> str:
        ids = self.older.get(found)
        if ids is None:
            ids = " ".join(map(str, self.codec.piece(found.encode())))
        if len(found) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[found] = ids
        return ids


#: What a worker process remembers of the codec it used last, by the codec's digest.
_KEPT: dict[str, _Remembered] = {}


def _remembered(codec: Codec) -> _Remembered:
    """Pre-tokens that this process has met; tasks of one worker share them."""
    if codec.digest not in _KEPT:
        _KEPT.clear()
        _KEPT[codec.digest] = _Remembered(codec)
    return _KEPT[codec.digest]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(a): int(b) for a, b in (p for p in pairs if p)}


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        raw = value.as_py()
        yield "" if raw is None else raw.decode("utf-8", "replace")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_BATCH):
            yield batch.slice(start, ROWS_PER_BATCH)


def _numbers(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int32, sep=" ") if joined else np.empty(0, np.int32)


def _encoder(codec: Codec) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(codec.pattern).findall
        remembered = _remembered(codec)
        for batch in _parts(batches):
            ids = []
            for text in _texts(batch.column("text")):
                joined = " ".join(map(remembered.__getitem__, pieces(text)))
                ids.append(_numbers(joined))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"]
            )

    return run


def _decoder(known: dict[int, bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = [
                b"".join(map(known.__getitem__, ids.as_py() or ())) for ids in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.binary())], names=["id", "decoded"]
            )

    return run


def _round_trip(codec: Codec, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(codec.pattern).findall
        remembered = _remembered(codec)
        known = _Bytes(codec)
        for batch in _parts(batches):
            counts, encoded, decoded, arrays = [], [], [], []
            for text in _texts(batch.column("text")):
                joined = " ".join(map(remembered.__getitem__, pieces(text)))
                ids = _numbers(joined)
                counts.append(len(ids))
                if with_ids:
                    arrays.append(ids)
                encoded.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(known.of(ids)).hexdigest())
            out = {
                "id": batch.column("id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(encoded, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if with_ids:
                out["ids"] = pa.array(arrays, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")
    )


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text"):
    """Id and ``ids`` (array of int) of every document.

    A null or empty text gives an empty array; bytes that are no UTF-8 are
    encoded as U+FFFD; repeated rows give repeated rows; other columns are not
    read. The vocabulary is of a fixed size and travels with the tasks.
    """
    kind = type_of(docs, id_col)
    return (
        _narrow(docs, id_col, text_col)
        .mapInArrow(_encoder(codec), f"id {kind}, ids array<int>")
        .withColumnRenamed("id", id_col)
    )


def decode(encoded: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "ids"):
    """Id and ``decoded`` (binary) of every array of ids; null gives no bytes."""
    kind = type_of(encoded, id_col)
    known = dict(zip(codec.ranks, codec.keys))
    return (
        encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
        .mapInArrow(_decoder(known), f"id {kind}, decoded binary")
        .withColumnRenamed("id", id_col)
    )


def round_trip(
    docs: DataFrame,
    codec: Codec,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document.

    Encodes and decodes in one pass; ``with_ids`` adds the ids as an array. The
    ids are digested as decimal numbers joined by a space. Rows are treated as
    in ``encode``.
    """
    kind = type_of(docs, id_col)
    columns = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    found = _narrow(docs, id_col, text_col).mapInArrow(
        _round_trip(codec, with_ids), columns + (", ids array<int>" if with_ids else "")
    )
    return found.withColumnRenamed("id", id_col)
