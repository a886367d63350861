"""Repeated word windows, found with a compressed FM-index per shard.

1. Every run of windows with the same minimizer (the least hash of the shorter
   shingles inside a window) is a segment. Equal windows have equal minimizers,
   so only segments with one that is found in several documents go on.
2. Equal segments are one, owned by the smallest id that has them.
3. Shards hold all segments of a minimizer. Each builds an FM-index over a
   wavelet matrix, and streams its segments through it by backward search: the
   matching statistics at every window, cut at the window's length, give the
   interval of all places with the same words, and so the smallest id.
4. Windows owned by a smaller id are intervals to remove from their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import few_rows, type_of
from stayrate.llm.near_dedup import _MUL, WordNumbers, _mixed
from stayrate.session import settle

#: Words of the shingles that minimizers are chosen from; a power of two.
SHINGLE = 16
#: Most windows of a segment, and words of one index.
SEGMENT = 128
SHARD_WORDS = 400_000
LAST = (1 << 63) - 1


def _doubled(values: np.ndarray, size: int, join: Callable) -> np.ndarray:
    """``join`` over every run of ``size`` values, by doubling."""
    width = 1
    while 2 * width <= size:
        values = join(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return join(values[:-rest], values[rest:]) if rest else values


def segments(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer) of the segments of a document."""
    if len(values) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    size = min(SHINGLE, window)
    shingles = values
    width = 1
    while width < size:
        step = min(width, size - width)
        shingles = _mixed(shingles[:-step] * _MUL + shingles[step:])
        width += step
    least = _doubled(shingles, window - size + 1, np.minimum)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    counts = np.diff(np.r_[starts, len(least)])
    pieces = -(-counts // SEGMENT)
    first = np.repeat(starts, pieces)
    part = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first + part * SEGMENT
    return begin, np.minimum(np.repeat(starts + counts, pieces) - begin, SEGMENT), least[begin]


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _scan(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: dict[str, list] = {c: [] for c in ("n", "sha", "start", "windows", "m", "seg")}
                for text in batch.column("text"):
                    words = (text.as_py() or b"").split()
                    values = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
                    starts, counts, least = segments(values, window)
                    out["n"].append(len(words))
                    out["sha"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                    out["start"].append(starts.astype(np.int32))
                    out["windows"].append(counts.astype(np.int32))
                    out["m"].append(least.view(np.int64))
                    ends = (starts + counts + window - 1).tolist()
                    out["seg"].append(
                        [_number(values[s:e].tobytes()) for s, e in zip(starts.tolist(), ends)]
                    )
                kinds = {"n": pa.int64(), "sha": pa.string()}
                lists = {"start": pa.int32(), "windows": pa.int32(), "m": pa.int64(), "seg": pa.int64()}
                kinds |= {c: pa.list_(k) for c, k in lists.items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("k"),
                        *(pa.array(out[c], kinds[c]) for c in kinds),
                    ],
                    names=["id", "k", *kinds],
                )

    return run


def _cut(window: int) -> Callable:
    """Words of the chosen segments of a document, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                words = part.column("text")[0].as_py().split()
                values = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
                chosen = part.column("chosen")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["m"] for c in chosen], pa.int64()),
                        pa.array([c["seg"] for c in chosen], pa.int64()),
                        pa.array([part.column("id")[0].as_py()] * len(chosen), pa.int64()),
                        pa.array(
                            [
                                values[c["start"] : c["start"] + c["windows"] + window - 1].tobytes()
                                for c in chosen
                            ],
                            pa.binary(),
                        ),
                    ],
                    names=["m", "seg", "id", "words"],
                )

    return run


class WaveletMatrix:
    """Rank queries over a sequence of small numbers, one bit vector a level."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (sequence >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            padded = np.zeros(-(-len(packed) // 8) * 8 + 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        everything = np.arange(symbols)
        self.starts = self._descend(everything, np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[i][block] + np.bitwise_count(self.words[i][block] & below)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, at) - self.starts[symbol]


def _paired(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Ranks of pairs."""
    return np.unique(one * (int(other.max()) + 1) + other, return_inverse=True)[1]


def _blocks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal ranks, and the run of every place."""
    edges = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1], True])
    return edges, np.repeat(np.arange(len(edges) - 1), np.diff(edges))


class FMIndex:
    """FM-index over segments, for patterns of up to ``window`` words."""

    def __init__(self, segs: list[np.ndarray], owners: np.ndarray, window: int) -> None:
        self.window = window
        lengths = np.array([len(s) for s in segs])
        self.ends = np.cumsum(lengths + 1) - 1
        words = np.concatenate(segs)
        alphabet, inverse = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(segs), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = inverse + 1
        self.text, self.symbols = text, len(alphabet) + 1
        ranked = {1: text}
        width = 1
        while 2 * width < window:
            ranked[2 * width] = _paired(ranked[width], np.roll(ranked[width], -width))
            width *= 2
        half = ranked[width]

        def ranks(size: int) -> np.ndarray:
            return _paired(half, np.roll(half, width - size)) if size > width else ranked[size]

        order = np.argsort(ranks(min(2 * width, window + 1)), kind="stable")
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=self.symbols))]
        self.matrix = WaveletMatrix(np.roll(text, 1)[order], self.symbols)
        self.wide_edges, self.wide = _blocks(ranks(window - 1)[order])
        edges, self.full = _blocks(ranks(window)[order])
        owner = np.repeat(owners, lengths + 1)[order]
        self.owner = np.minimum.reduceat(owner, edges[:-1])

    def owners(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(segment, window, smallest owner) by backward search over all segments."""
        starts = np.r_[0, self.ends[:-1] + 1]
        active = np.arange(len(self.ends))
        place = self.ends - 1
        symbol = self.text[place]
        low, high = self.less[symbol], self.less[symbol + 1]
        length = 1
        while len(active):
            if length >= self.window:
                yield active, place - starts[active], self.owner[self.full[low]]
            more = place > starts[active]
            active, place, low, high = active[more], place[more] - 1, low[more], high[more]
            if length >= self.window:
                # Drop the last word: all places that share the words before it.
                block = self.wide[low]
                low, high = self.wide_edges[block], self.wide_edges[block + 1]
            symbol = self.text[place]
            low = self.less[symbol] + self.matrix.rank(symbol, low)
            high = self.less[symbol] + self.matrix.rank(symbol, high)
            length += 1


def _match(window: int) -> Callable:
    """For every segment the runs of windows that a smaller id owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0

        def solve() -> pa.RecordBatch:
            ms, numbers, ids, raw = zip(*held)
            segs = [np.frombuffer(w, np.uint64) for w in raw]
            own = np.array(ids, np.int64)
            taken = [np.zeros(len(s) - window + 1, bool) for s in segs]
            index = FMIndex(segs, own, window)
            for which, at, owner in index.owners():
                for i, j in zip(*(x[owner < own[which]].tolist() for x in (which, at))):
                    taken[i][j] = True
            begins, counts = [], []
            for mask in taken:
                edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                begins.append(edges[::2].astype(np.int32))
                counts.append((edges[1::2] - edges[::2]).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ms, pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(begins, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                names=["m", "seg", "owner", "begins", "counts"],
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("m", "seg", "id", "words"))
            for row in zip(*columns):
                if words >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield solve()
                    held, words = [], 0
                held.append(row)
                words += len(row[3]) // 8
        if held:
            yield solve()

    return run


def _remove(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = text.as_py().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for span in spans.as_py():
                    edges[span["start"]] += 1
                    edges[span["start"] + span["windows"] + window - 1] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("k"),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.binary()),
                ],
                names=["id", "k", "n_removed", "cut_sha256", "kept_text"],
            )

    return run


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, texts) of the search for repeated windows.

    ``documents`` has id, k (hash of the text), n (words) and sha; ``spans`` has
    id, k, start and windows: every run of windows that also start in a document
    with a smaller id; ``texts`` has id, k and text. Ids are longs; a null id is
    the largest of all, and rows with one id are not smaller than each other.
    """
    if type_of(docs, id_col) not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be an integer")
    if window < 2:
        raise ValueError("a window has two words at least")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(text).alias("k"),
        text.alias("text"),
    )
    scan = settle(
        texts.mapInArrow(
            _scan(window),
            "id long, k long, n long, sha string, start array<int>, windows array<int>, "
            "m array<long>, seg array<long>",
        )
    )
    zipped = F.explode(F.arrays_zip("start", "windows", "m", "seg"))
    found = scan.select("id", "k", zipped.alias("s")).select("id", "k", "s.*")
    shared = settle(
        found.groupBy("m")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low < high")
        .select("m")
    )
    found = settle(found.join(few_rows(shared), "m", "left_semi"))
    first = F.min(F.struct("id", "k", "start", "windows")).alias("f")
    distinct = found.groupBy("m", "seg").agg(first)
    chosen = settle(
        distinct.groupBy(F.col("f.id").alias("id"), F.col("f.k").alias("k")).agg(
            F.collect_list(F.struct("f.start", "f.windows", "m", "seg")).alias("chosen")
        )
    )
    # Repeats of a row hold the same segments.
    wanted = texts.join(few_rows(settle(chosen.select("id", "k"))), ["id", "k"], "left_semi")
    cut = (
        wanted.join(chosen, ["id", "k"])
        .select("id", "text", "chosen")
        .mapInArrow(_cut(window), "m long, seg long, id long, words binary")
    )
    matched = (
        cut.repartition("m")
        .sortWithinPartitions("m", "seg")
        .mapInArrow(
            _match(window),
            "m long, seg long, owner long, begins array<int>, counts array<int>",
        )
        .dropDuplicates(["m", "seg"])
    )
    both = found.join(settle(matched), ["m", "seg"])
    later = both.where("id > owner").select("id", "k", "start", "windows")
    runs = F.explode(F.arrays_zip("begins", "counts")).alias("r")
    own = (
        both.where("id = owner")
        .select("id", "k", "start", runs)
        .select(
            "id", "k", (F.col("start") + F.col("r.begins")).alias("start"),
            F.col("r.counts").alias("windows"),
        )
    )
    return scan, later.unionAll(own), texts


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50
) -> DataFrame:
    """Id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` of every document.

    Words are runs of anything but space and the control characters tab to
    return. A word is removed when a window of ``window`` consecutive words over
    it also starts in a document with a smaller id, judged on the texts as given.
    ``kept_text`` is null where nothing is removed; otherwise, and in the
    digest, the kept words are joined by a space.

    A null text has no words, and texts shorter than a window lose none. A null
    id is larger than all others; rows with one id do not remove each other's
    words. Repeated rows get equal results, an empty table none; other columns
    are not read. The segments of one minimizer meet in one task, each distinct
    segment once.
    """
    scan, spans, texts = repeated_windows(docs, id_col, text_col, window)
    lists = settle(
        spans.groupBy("id", "k").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    )
    hit = texts.join(few_rows(settle(lists.select("id", "k"))), ["id", "k"], "left_semi")
    cut = (
        hit.join(lists, ["id", "k"])
        .select("id", "k", "text", "spans")
        .mapInArrow(
            _remove(window),
            "id long, k long, n_removed long, cut_sha256 string, kept_text binary",
        )
        .dropDuplicates(["id", "k"])
    )
    kind = type_of(docs, id_col)
    return (
        scan.select("id", "k", "n", "sha")
        .join(cut, ["id", "k"], "left")
        .select(
            F.when(F.col("id") != LAST, F.col("id")).cast(kind).alias(id_col),
            F.col("n").alias("n_words"),
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("cut_sha256", "sha").alias("kept_sha256"),
            F.col("kept_text").cast("string").alias("kept_text"),
        )
    )
