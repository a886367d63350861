"""Jaccard join of documents on word n-grams, by a blocked sparse matrix product.

The incidence matrix has a row per distinct set and a column per n-gram. A row that
can reach the threshold with anything shares nearly all of its columns with other
rows, so a block of the columns is enough to drop most rows: the columns that no
other row holds are counted, and a row with more of them than its size allows is
gone. The rest of the matrix falls apart into groups that share rare columns. Inside
a group the product of the matrix with its transpose is made block by block; only
blocks of fitting sizes meet, and pairs below the bound that follows from their
sizes are dropped between the column blocks of a product.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import few_rows, type_of
from stayrate.llm.components import connected_components
from stayrate.llm.near_dedup import WordNumbers, shingle_set
from stayrate.operators.skew import lookup_join
from stayrate.session import release, settle

#: One in so many columns is counted before rows are dropped.
SLICE = 4
#: Entries a task holds before it sends them, and entries meant for one bucket.
CHUNK = 2_000_000
BUCKET = 2_000_000
#: Rows of a chunk that are sent for one column; beyond them it is known to be shared.
MANY = 8
#: Rows and column entries of one block of the matrix.
BLOCK_ROWS = 2048
BLOCK_ENTRIES = 4_000_000
#: Rows of a strip of the product; pairs made at once from sparse columns.
STRIP = 256
PAIRS = 4_000_000

PACKED = (
    "id {id}, k long, n long, sliced long, print long, set_key binary, "
    "bucket int, columns binary, owners binary, credit long"
)
NAMES = (
    "id", "k", "n", "sliced", "print", "set_key", "bucket", "columns", "owners", "credit"
)


def required(percent: int, n: int) -> int:
    """Least intersection of a set of this size with any set that it is linked with."""
    return -(-percent * n // 100)


def _print(key: bytes) -> int:
    """64-bit name of a set in the counts; zero stands for several sets."""
    return int.from_bytes(key[:8], "little", signed=True) or 1


def pack(
    columns: np.ndarray, owners: np.ndarray, bits: int
) -> tuple[list[tuple[int, bytes, bytes]], tuple[np.ndarray, np.ndarray]]:
    """Rows (bucket, columns, owners) of a chunk, and (owner, count) of columns held by many.

    Of a column's 64 bits the first name the bucket, and the next 32 are sent:
    two columns taken for one only keep a row that could have been dropped.
    """
    order = np.lexsort((owners, columns))
    columns, owners = columns[order], owners[order]
    new = np.ones(len(columns), bool)
    new[1:] = (columns[1:] != columns[:-1]) | (owners[1:] != owners[:-1])
    columns, owners = columns[new], owners[new]
    first = np.ones(len(columns), bool)
    first[1:] = columns[1:] != columns[:-1]
    run = np.cumsum(first) - 1
    many = (np.bincount(run, minlength=1) > MANY)[run] if len(run) else np.zeros(0, bool)
    credit = np.unique(owners[many], return_counts=True)
    owners = np.where(many, 0, owners)
    sent = ~many | first
    columns, owners = columns[sent], owners[sent]
    buckets = (columns >> np.uint64(64 - bits)).astype(np.int64)
    low = ((columns >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edges = np.flatnonzero(np.diff(buckets)) + 1
    rows = []
    for start, stop in zip([0, *edges], [*edges, len(buckets)]):
        if stop > start:
            rows.append(
                (int(buckets[start]), low[start:stop].tobytes(), owners[start:stop].tobytes())
            )
    return rows, credit


def shared(columns: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, count) of the columns that more than one set holds."""
    order = np.lexsort((owners, columns))
    columns, owners = columns[order], owners[order]
    new = np.ones(len(columns), bool)
    new[1:] = (columns[1:] != columns[:-1]) | (owners[1:] != owners[:-1])
    columns, owners = columns[new], owners[new]
    first = np.ones(len(columns), bool)
    first[1:] = columns[1:] != columns[:-1]
    run = np.cumsum(first) - 1
    several = np.bincount(run, minlength=1) > 1
    several[run[owners == 0]] = True
    return np.unique(owners[several[run] & (owners != 0)], return_counts=True)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    """A batch with nulls in the columns not given."""
    size = len(next(iter(columns.values())))
    kinds = {
        "k": pa.int64(), "n": pa.int64(), "sliced": pa.int64(), "print": pa.int64(),
        "set_key": pa.binary(), "bucket": pa.int32(), "columns": pa.binary(),
        "owners": pa.binary(), "credit": pa.int64(),
    }
    found = {c: columns.get(c, pa.nulls(size, kinds.get(c))) for c in NAMES}
    return pa.RecordBatch.from_pydict(found)


def _count_columns(width: int, bits: int, id_type: pa.DataType) -> Callable:
    """A row per document, and the packed columns of every chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        held: list[tuple[np.ndarray, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            columns = np.concatenate([c for c, _ in held])
            owners = np.repeat([np.int64(o) for _, o in held], [len(c) for c, _ in held])
            rows, (names, counts) = pack(columns, owners, bits)
            held.clear()
            if rows:
                bucket, sent, own = zip(*rows)
                yield _batch(
                    id=pa.nulls(len(rows), id_type),
                    bucket=pa.array(bucket, pa.int32()),
                    columns=pa.array(sent, pa.binary()),
                    owners=pa.array(own, pa.binary()),
                )
            if len(names):
                yield _batch(
                    id=pa.nulls(len(names), id_type),
                    print=pa.array(names, pa.int64()),
                    credit=pa.array(counts, pa.int64()),
                )

        size = 0
        for batch in batches:
            n, sliced, prints, keys = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py() or b"", width, numbers)
                some = found[found % np.uint64(SLICE) == 0]
                n.append(len(found))
                sliced.append(len(some))
                key = hashlib.md5(found.tobytes()).digest() if len(found) else None
                keys.append(key)
                prints.append(_print(key) if key else None)
                if len(some):
                    held.append((some, prints[-1]))
                    size += len(some)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
            yield _batch(
                id=batch.column("id"),
                k=batch.column("k"),
                n=pa.array(n, pa.int64()),
                sliced=pa.array(sliced, pa.int64()),
                print=pa.array(prints, pa.int64()),
                set_key=pa.array(keys, pa.binary()),
            )
        yield from flush()

    return run


def _credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, credit) of each bucket; rows come sorted by bucket."""
    columns: list[bytes] = []
    owners: list[bytes] = []
    at = None

    def settled() -> Iterator[pa.RecordBatch]:
        names, counts = shared(
            np.frombuffer(b"".join(columns), np.uint32), np.frombuffer(b"".join(owners), np.int64)
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(counts, pa.int64())], names=["print", "credit"]
        )

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "columns", "owners")))
        for bucket, some, own in rows:
            if bucket != at and columns:
                yield from settled()
                columns, owners = [], []
            at = bucket
            columns.append(some)
            owners.append(own)
    if columns:
        yield from settled()


def _whole_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [shingle_set(t.as_py() or b"", width, numbers) for t in part.column("text")]
                keys = [hashlib.md5(f.tobytes()).digest() for f in found]
                right = [k == w.as_py() for k, w in zip(keys, part.column("set_key"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())),
                    ],
                    names=["node", "n", "columns"],
                ).filter(pa.array(right, pa.bool_()))

    return run


def _entries(sets: list[np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the sets' entries, sorted by column and row."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(places, kind="stable")
    return places[order], rows[order]


def _bitmaps(columns: np.ndarray, rows: np.ndarray, height: int, width: int) -> np.ndarray:
    """One row of 64-bit words per set, one bit per column."""
    bits = np.zeros((height, -(-max(width, 1) // 64) * 64), np.uint8)
    bits[rows, columns] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def product_links(
    sizes: np.ndarray,
    sets: list[np.ndarray],
    other_sizes: np.ndarray | None,
    other_sets: list[np.ndarray] | None,
    percent: int,
) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, linked) for strips of the product of two blocks, or of one with itself.

    Overlaps are summed over the sparse columns first, pair by pair. Pairs that
    could not reach the bound of their sizes if they shared every dense column are
    dropped, and dense columns are counted, 64 at a time, for the others alone.
    """
    own = other_sets is None
    b_sizes = sizes if own else other_sizes
    b_sets = sets if own else other_sets
    n, m = len(sets), len(b_sets)
    split = sum(map(len, sets))
    joined = np.concatenate([*sets] if own else [*sets, *b_sets])
    width, places = np.unique(joined, return_inverse=True)
    width = len(width)
    a_columns, a_rows = _entries(sets, places[:split])
    b_columns, b_rows = (a_columns, a_rows) if own else _entries(b_sets, places[split:])
    a_held = np.bincount(a_columns, minlength=width)
    b_held = np.bincount(b_columns, minlength=width)
    met = a_held * b_held
    dense = met * 256 > n * m
    number = np.cumsum(dense) - 1
    wide = int(dense.sum())
    a_dense, b_dense = dense[a_columns], dense[b_columns]
    a_bits = _bitmaps(number[a_columns[a_dense]], a_rows[a_dense], n, wide)
    b_bits = a_bits if own else _bitmaps(number[b_columns[b_dense]], b_rows[b_dense], m, wide)
    a_left = np.bincount(a_rows[a_dense], minlength=n)
    b_left = a_left if own else np.bincount(b_rows[b_dense], minlength=m)
    thin = ~a_dense & (b_held[a_columns] > 0)
    columns, rows = a_columns[thin], a_rows[thin]
    by_row = np.argsort(rows, kind="stable")
    columns, rows = columns[by_row], rows[by_row]
    starts = np.concatenate([[0], np.cumsum(b_held)])
    for top in range(0, n, STRIP):
        bottom = min(top + STRIP, n)
        both = np.zeros((bottom - top) * m, np.int32)
        low, high = np.searchsorted(rows, [top, bottom])
        at = low
        while at < high:
            # So many entries that their pairs fit; at least one.
            many = np.cumsum(b_held[columns[at:high]])
            stop = at + max(1, int(np.searchsorted(many, PAIRS, side="right")))
            some, counts = columns[at:stop], b_held[columns[at:stop]]
            offset = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            others = b_rows[offset + np.arange(int(counts.sum()))]
            cells = np.repeat((rows[at:stop] - top) * m, counts) + others
            both += np.bincount(cells, minlength=len(both)).astype(np.int32)
            at = stop
        both = both.reshape(bottom - top, m)
        strip = sizes[top:bottom, None]
        small, large = np.minimum(strip, b_sizes), np.maximum(strip, b_sizes)
        # Overlap o reaches the threshold where (100 + p) o >= p (a + b).
        least = -(-percent * (small + large) // (100 + percent))
        fits = 100 * small >= percent * large
        fits &= both + np.minimum(a_left[top:bottom, None], b_left) >= least
        if own:
            fits &= np.arange(m) > np.arange(top, bottom)[:, None]
        x, y = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        if len(x) and len(y):
            more = np.zeros((len(x), len(y)), np.int32)
            for word in range(a_bits.shape[1] if wide else 0):
                left = a_bits[top + x, word]
                right = b_bits[y, word]
                more += np.bitwise_count(left[:, None] & right[None, :])
            both[np.ix_(x, y)] += more
        yield top, fits & (both >= least)


def _product(percent: int) -> Callable:
    """Links of each region's blocks: counts (a, null, links), and a forest (a, b, null)."""

    def solve(crossed: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        split = sum(1 for r in rows if r[0] == 0)
        if crossed and split in (0, len(rows)):
            return
        _, nodes, sizes, docs, sets = zip(*rows)
        nodes, sizes, docs = (np.array(v, np.int64) for v in (nodes, sizes, docs))
        counts = np.zeros(len(rows), np.int64)
        groups = np.arange(len(rows))
        ends = []
        found = product_links(
            sizes[:split],
            list(sets[:split]),
            sizes[split:] if crossed else None,
            list(sets[split:]) if crossed else None,
            percent,
        )
        shift = split if crossed else 0
        for top, linked in found:
            height = len(linked)
            counts[top : top + height] += linked @ docs[shift : shift + linked.shape[1]]
            counts[shift : shift + linked.shape[1]] += docs[top : top + height] @ linked
            for i in np.flatnonzero(linked.any(axis=1)):
                others = np.flatnonzero(linked[i]) + shift
                for j in others[groups[others] != groups[top + i]]:
                    if groups[j] != groups[top + i]:
                        ends.append((nodes[top + i], nodes[j]))
                        groups[groups == groups[j]] = groups[top + i]
        some = np.flatnonzero(counts)
        a = np.concatenate([nodes[some], np.array([x for x, _ in ends], np.int64)])
        b = [None] * len(some) + [int(y) for _, y in ends]
        links = counts[some].tolist() + [None] * len(ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        region = crossed = None
        for batch in batches:
            lists = batch.column("columns")
            values = lists.values.to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()
            names = ("region", "crossed", "side", "node", "n", "docs")
            rows = zip(*(batch.column(c).to_pylist() for c in names))
            for at, (key, two, *row) in enumerate(rows):
                if key != region:
                    if len(held) > 1:
                        yield from solve(crossed, held)
                    held, region, crossed = [], key, two
                held.append((*row, values[starts[at] : starts[at + 1]].copy()))
        if len(held) > 1:
            yield from solve(crossed, held)

    return run


def _rare_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``n``, ``columns`` (shared ones, rare first) of the rows that may be linked."""
    cells = sets.select("node", "n", F.explode("columns").alias("column"))
    held = settle(
        cells.groupBy("column")
        .agg(F.count("*").alias("held"))
        .where("held > 1")
        .withColumn("rows", F.col("held"))
    )
    total = F.lit(sets.count())
    kept = lookup_join(cells, held, ["column"], "held", total).where("rows IS NOT NULL")
    lists = kept.groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("rows", "column"))).alias("listed")
    )
    return lists.where(100 * F.size("listed") >= percent * F.col("n")).select(
        "node", "n", F.col("listed.column").alias("columns")
    )


def _groups(lists: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``component`` of rows that share one of their rarest columns.

    A row that shares none of its first m - r + 1 columns with another one, m
    being all it has and r the intersection it needs, shares less than r.
    """
    least = F.ceil(percent * F.col("n") / 100).cast("int")
    prefix = F.expr("slice(columns, 1, size(columns) - needed + 1)")
    cells = settle(
        lists.withColumn("needed", least).select("node", F.explode(prefix).alias("column"))
    )
    hubs = settle(
        cells.groupBy("column").agg(F.count("*").alias("held"), F.min("node").alias("hub")).where("held > 1")
    )
    met = lookup_join(cells, hubs, ["column"], "held", F.lit(lists.count()))
    edges = settle(
        met.where("hub < node").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    )
    return settle(connected_components(edges))


def _dealt(lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Rows of each region: ``region``, ``crossed``, ``side``, ``node``, ``n``, ``docs``, ``columns``.

    A group that fits in one block is a region. Others are cut into bands of
    sizes, such that linked rows are in the same or in neighbouring bands, and
    bands into shares of bounded rows and entries; every two shares of fitting
    bands are a region, whose sides are compared with each other.
    """
    # Just wider than the threshold, so that rounding parts no linked sizes further.
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else math.log(2)
    placed = settle(
        lists.join(groups, "node")
        .withColumn("entries", F.size("columns").cast("long"))
        .withColumn("band", F.floor(F.log(F.col("n")) / step).cast("int"))
    )
    bands = settle(
        placed.groupBy("component", "band").agg(
            F.count("*").alias("held"), F.sum("entries").alias("entries")
        )
    )
    shares = F.ceil(
        F.greatest(F.col("held") / BLOCK_ROWS, F.col("entries") / BLOCK_ENTRIES)
    ).cast("int")
    whole = bands.groupBy("component").agg(
        ((F.sum("held") <= BLOCK_ROWS) & (F.sum("entries") <= BLOCK_ENTRIES)).alias("one")
    )
    cut = bands.join(whole, "component").select("component", "band", "held", "one", shares.alias("shares"))
    above = cut.select(
        "component", (F.col("band") - 1).alias("band"), F.col("shares").alias("above")
    )
    below = cut.select(
        "component", (F.col("band") + 1).alias("band"), F.col("shares").alias("below")
    )
    keys = ["component", "band"]
    facts = settle(cut.join(above, keys, "left").join(below, keys, "left"))
    rows = lookup_join(placed, facts, keys, "held", F.lit(lists.count()))
    share = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")

    def to(count: str | Column) -> Column:
        """Numbers of so many shares; none for null."""
        size = F.coalesce(F.col(count) if isinstance(count, str) else count, F.lit(0))
        return F.filter(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda _: size > 0)

    def place(low_band: Column, low: Column, high: Column, crossed: Column, side: Column) -> Column:
        """Region of two shares; shares of one band and of two bands have other names."""
        name = F.concat_ws(":", "component", low_band, low, high)
        return F.struct(name.alias("region"), crossed.alias("crossed"), side.alias("side"))

    band, own = F.col("band"), F.col("share")
    zero, one = F.lit(0), F.lit(1)
    within = F.transform(
        to("shares"),
        lambda t: place(
            F.concat(band.cast("string"), F.lit("=")),
            F.least(own, t),
            F.greatest(own, t),
            own != t,
            F.when(own > t, one).otherwise(zero),
        ),
    )
    up = F.transform(to("above"), lambda t: place(band, own, t, F.lit(True), zero))
    down = F.transform(to("below"), lambda t: place(band - 1, t, own, F.lit(True), one))
    alone = F.array(
        F.struct(
            F.col("component").cast("string").alias("region"),
            F.lit(False).alias("crossed"),
            zero.alias("side"),
        )
    )
    where = F.when(F.col("one"), alone).otherwise(F.concat(within, up, down))
    spread = rows.withColumn("share", share).select(
        F.explode(where).alias("at"), "node", "n", "docs", "columns"
    )
    return spread.select("at.region", "at.crossed", "at.side", "node", "n", "docs", "columns")


def ngram_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``n_links``.

    Texts are lower-cased (A-Z) and split into words at ASCII white space; a
    document's set holds its distinct shingles of ``width`` words, with fewer
    words the whole text as one, and is compared by 64-bit numbers of them.
    Documents link when their sets share ``percent`` per cent (51 to 100) of
    their union; ``component_id`` is the smallest id reachable over links, and
    ``n_links`` says with how many other documents one is linked. No link is
    missed but for equal numbers of different shingles or sets.

    A null text counts as empty; a document without words is linked with none
    and its own component. Equal sets are one row of the matrix however many
    documents have them. A null id takes part in links; a component without any
    id has none. A repeated row is a document of its own. An empty table gives
    no rows; other columns are not read.
    """
    kind = type_of(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    # A word and its space have some five bytes.
    bits = max(4, math.ceil(math.log2(size / 5 / SLICE / BUCKET + 1)))
    id_type = pa.int64() if kind == "bigint" else None
    if id_type is None:
        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(docs.schema[id_col].dataType)
    packed = settle(
        rows.mapInArrow(_count_columns(width, bits, id_type), PACKED.format(id=kind))
    )
    signed = packed.where("n IS NOT NULL")
    classes = settle(
        signed.where("n > 0")
        .groupBy("set_key", "print", "n", "sliced")
        .agg(
            F.count("*").alias("docs"),
            F.min("id").alias("least_id"),
            F.min(F.struct("id", "k")).alias("first"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    sent = packed.where("bucket IS NOT NULL").select("bucket", "columns", "owners")
    counted = sent.repartition("bucket").sortWithinPartitions("bucket")
    counted = counted.mapInArrow(_credits, "print long, credit long")
    credit = (
        packed.where("credit IS NOT NULL")
        .select("print", "credit")
        .unionAll(counted)
        .groupBy("print")
        .agg(F.sum("credit").alias("credit"))
    )
    allowed = F.col("n") - F.ceil(percent * F.col("n") / 100)
    lone = F.col("sliced") - F.coalesce("credit", F.lit(0))
    left = settle(
        classes.join(credit, "print", "left")
        .where(lone <= allowed)
        .select("node", "set_key", "docs", "first")
    )
    wanted = left.select(F.col("first.id").alias("wid"), F.col("first.k").alias("wk"), "node", "set_key")
    texts = rows.join(
        few_rows(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("k") == F.col("wk"))
    ).select("node", "set_key", "text")
    sets = settle(
        texts.dropDuplicates(["node"]).mapInArrow(
            _whole_sets(width), "node long, n long, columns array<long>"
        )
    )
    lists = settle(_rare_lists(sets, percent))
    release(sets)
    groups = _groups(lists, percent)
    parts = _dealt(lists.join(left.select("node", "docs"), "node"), groups, percent)
    links = settle(
        parts.repartition("region")
        .sortWithinPartitions("region", "side", "node")
        .mapInArrow(_product(percent), "a long, b long, links long")
    )
    found = settle(connected_components(links.where("b IS NOT NULL").select("a", "b")))
    counts = links.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(
        F.sum("links").alias("links")
    )
    named = found.join(classes.select("node", "least_id"), "node")
    firsts = settle(
        named.groupBy("component").agg(F.min("least_id").alias("first_id"), F.count("*").alias("held"))
    )
    nodes = F.lit(found.count())
    joined = lookup_join(found, firsts, ["component"], "held", nodes).select("node", "first_id")
    facts = settle(
        classes.select("node", "set_key", "docs", "least_id")
        .join(joined, "node", "left")
        .join(counts, "node", "left")
        .select(
            "set_key",
            "docs",
            F.coalesce("first_id", "least_id").alias("component"),
            (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    total = F.lit(signed.count())
    out = lookup_join(signed.select("id", "n", "set_key"), facts, ["set_key"], "docs", total)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
