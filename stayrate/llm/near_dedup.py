"""Near duplicates by an LSH forest over MinHash signatures.

A signature is read in several orders, each starting at another place. In every
order, documents that share the first values form a region; a region that is too
full is split by longer prefixes, as deep as it needs. Inside a region the
documents with the longest agreement are candidates. Candidates are confirmed on
whole shingle sets, best first, and what is already connected is not compared
again; a last pass compares whatever still may be linked inside its region. What
the split of a full region has parted is joined exactly, on rare shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import few_rows, type_of
from stayrate.llm.components import connected_components, partial_components
from stayrate.operators.skew import lookup_join
from stayrate.session import settle

#: Values of a signature; an order starts at every third.
VALUES = 64
STEP = 3
ORDERS = tuple(range(0, VALUES - STEP + 1, STEP))
#: Prefix lengths of a region, tried in turn while it holds more documents than this.
DEPTHS = (3, 6, 12, 24, VALUES)
REGION = 2048
#: Parted documents with a shingle that more of them hold are compared as a crowd.
RARE = 16
#: Shingles of a crowd held by at most this many documents are counted pair by pair.
SPARSE = 32
#: Best neighbours and central documents compared first.
NEIGHBOURS = 2
CENTRES = 3
REMEMBERED = 300_000
SPREAD = 4.5

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordNumbers(dict):
    """64-bit number of a word, remembered for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        number = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = number
        return number


def shingle_set(text: bytes, width: int, numbers: WordNumbers) -> np.ndarray:
    """Sorted numbers of the distinct shingles of a text; bytes split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        found = _mixed(found * _MUL + values[i : len(words) - size + 1 + i])
    return np.unique(found)


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions x -> (a x + b) / 2**32."""
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), 2048):
        some = shingles[start : start + 2048]
        hashed = (some[None, :] * factors[:, None] + offsets[:, None]) >> np.uint64(32)
        np.minimum(least, hashed.min(axis=1).astype(np.uint32), out=least)
    return least


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * VALUES + 1, dtype=np.uint64)
    numbers = _mixed(seeds * _MUL)
    return numbers[:VALUES] | np.uint64(1), numbers[VALUES:]


def _sign(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, (factors, offsets) = WordNumbers(), _hash_functions()
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py() or b"", width, numbers)
                sizes.append(len(found))
                if len(found):
                    keys.append(hashlib.md5(found.tobytes()).digest())
                    # Most significant byte first, so that bytes sort as the numbers do.
                    signatures.append(signature(found, factors, offsets).astype(">u4").tobytes())
                else:
                    keys.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("k"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["id", "k", "n_shingles", "set_key", "signature"],
            )

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [shingle_set(t.as_py() or b"", width, numbers) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        part.column("set_key"),
                        pa.array([hashlib.md5(f.tobytes()).digest() for f in found], pa.binary()),
                        pa.array([f.tobytes() for f in found], pa.binary()),
                    ],
                    names=["node", "set_key", "own_key", "shingles"],
                )

    return run


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, other in zip(batch.column("sa"), batch.column("sb")):
                x = np.frombuffer(one.as_py(), np.uint64)
                y = np.frombuffer(other.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(linked, pa.bool_()))

    return run


def _agreement(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of equal values for each of rows x others, one byte a value."""
    found = np.zeros((len(rows), len(others)), np.uint8)
    columns = np.ascontiguousarray(others.T)
    for i in range(VALUES):
        found += rows[:, i, None] == columns[i][None, :]
    return found


def _fitting(
    sizes: np.ndarray, marks: np.ndarray, rows: slice, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Agreement of rows with all documents, and where a link is not ruled out."""
    agreed = _agreement(marks[rows], marks)
    small = np.minimum(sizes[rows, None], sizes[None, :])
    large = np.maximum(sizes[rows, None], sizes[None, :])
    fits = (agreed >= least_agreement(percent)) & (100 * small >= percent * large)
    index = np.arange(rows.start, rows.stop)
    fits[index - rows.start, index] = False
    return agreed, fits


def region_pairs(
    nodes: np.ndarray, sizes: np.ndarray, marks: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agreement) of a region's first candidates, a < b.

    These are every document's best neighbours, and its agreement with the
    region's central documents. Pairs whose sizes rule a link out are none.
    """
    n, out = len(nodes), []
    totals = np.zeros(n)
    for start in range(0, n, 256):
        rows = slice(start, min(start + 256, n))
        agreed, fits = _fitting(sizes, marks, rows, percent)
        totals[rows] = agreed.sum(axis=1, dtype=np.int64)
        ranked = np.where(fits, agreed, 0)
        width = min(NEIGHBOURS, n)
        top = np.argpartition(-ranked.astype(np.int16), width - 1, axis=1)[:, :width]
        x = np.repeat(np.arange(len(ranked)), width)
        y = top.ravel()
        kept = fits[x, y]
        x, y = x[kept], y[kept]
        out.append((x + start, y, agreed[x, y]))
    for centre in np.argsort(-totals, kind="stable")[:CENTRES]:
        agreed, fits = _fitting(sizes, marks, slice(centre, centre + 1), percent)
        y = np.flatnonzero(fits[0])
        out.append((np.full(len(y), centre), y, agreed[0, y]))
    x, y, agreed = (np.concatenate(part) for part in zip(*out))
    return np.minimum(nodes[x], nodes[y]), np.maximum(nodes[x], nodes[y]), agreed


def undecided(
    sizes: np.ndarray, marks: np.ndarray, groups: np.ndarray, percent: int
) -> np.ndarray:
    """Which documents of a region may be linked with one of another group."""
    found = np.zeros(len(sizes), bool)
    for start in range(0, len(sizes), 256):
        rows = slice(start, min(start + 256, len(sizes)))
        _, fits = _fitting(sizes, marks, rows, percent)
        found[rows] = (fits & (groups[rows, None] != groups[None, :])).any(axis=1)
    return found


def region_links(
    sizes: np.ndarray,
    marks: np.ndarray,
    groups: np.ndarray,
    sets: list[np.ndarray],
    percent: int,
) -> list[tuple[int, int]]:
    """Places of linked documents from different groups; whole sets are compared.

    Groups grow together as links are found, so that no more links come out
    than there are documents. Everything that is not ruled out is compared:
    one document's set is marked, and counted in all later sets at once.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(distinct), bool)
    groups, links = groups.copy(), []
    for i in range(len(sizes) - 1):
        _, fits = _fitting(sizes, marks, slice(i, i + 1), percent)
        later = fits[0, i + 1 :] & (groups[i + 1 :] != groups[i])
        if not later.any():
            continue
        own = places[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        offset = starts[i + 1]
        both = np.add.reduceat(marked[places[offset:]], starts[i + 1 :] - offset, dtype=np.int64)
        marked[own] = False
        union = sizes[i] + sizes[i + 1 :] - both
        for j in np.flatnonzero(later & (100 * both >= percent * union)) + i + 1:
            if groups[j] != groups[i]:
                links.append((i, j))
                groups[groups == groups[j]] = groups[i]
    return links


def crowd_links(
    sizes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Places of linked documents from different groups; nothing is ruled out by signatures.

    Groups grow together as links are found, so that no more links come out
    than there are documents.
    """
    n = len(sizes)
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(n), sizes)
    order = np.argsort(places, kind="stable")
    places, owners = places[order], owners[order]
    held = np.bincount(places)
    both = np.zeros((n, n), np.float32)
    # Owners of a shingle lie side by side, in ascending order.
    few = held[places] <= SPARSE
    token, owner = places[few], owners[few]
    for step in range(1, min(SPARSE, len(token))):
        same = token[step:] == token[:-step]
        if not same.any():
            break
        np.add.at(both, (owner[:-step][same], owner[step:][same]), 1)
    number = np.cumsum(held > SPARSE) - 1
    token, owner = number[places[~few]], owners[~few]
    for start in range(0, int(number[-1]) + 1, 2048):
        low, high = np.searchsorted(token, [start, start + 2048])
        holds = np.zeros((n, 2048), np.float32)
        holds[owner[low:high], token[low:high] - start] = 1
        both += holds @ holds.T
    groups, links = groups.copy(), []
    for i in range(n - 1):
        shared = both[i, i + 1 :].astype(np.int64)
        linked = 100 * shared >= percent * (sizes[i] + sizes[i + 1 :] - shared)
        for j in np.flatnonzero(linked & (groups[i + 1 :] != groups[i])) + i + 1:
            if groups[j] != groups[i]:
                links.append((i, j))
                groups[groups == groups[j]] = groups[i]
    return links


def least_agreement(percent: int) -> int:
    """Equal values that a linked pair reaches but for one case in 100,000."""
    share = percent / 100
    return max(1, int(VALUES * share - SPREAD * (VALUES * share * (1 - share)) ** 0.5))


def _by_region(columns: tuple[str, ...], solve: Callable) -> Callable:
    """Applies ``solve`` to the rows of each region; rows come sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        region = None
        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("region", *columns))
            for key, *row in zip(*values):
                if key != region:
                    if len(held) > 1:
                        yield from solve(region, *zip(*held))
                    held, region = [], key
                held.append(row)
        if len(held) > 1:
            yield from solve(region, *zip(*held))

    return run


def _mark_table(marks: tuple[bytes, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), VALUES)


def _candidates(percent: int) -> Callable:
    def solve(region: int, nodes: tuple, sizes: tuple, marks: tuple) -> Iterator[pa.RecordBatch]:
        a, b, agreed = region_pairs(
            np.array(nodes, np.int64), np.array(sizes, np.int64), _mark_table(marks), percent
        )
        unique = np.unique(np.stack([a, b, agreed.astype(np.int64)]), axis=1)
        for start in range(0, unique.shape[1], 65536):
            part = unique[:, start : start + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0]), pa.array(part[1]), pa.array(part[2].astype(np.int32))],
                names=["a", "b", "agreed"],
            )

    return _by_region(("node", "n", "marks"), solve)


def _undecided(percent: int) -> Callable:
    def solve(
        region: int, nodes: tuple, sizes: tuple, marks: tuple, groups: tuple
    ) -> Iterator[pa.RecordBatch]:
        found = undecided(
            np.array(sizes, np.int64), _mark_table(marks), np.array(groups, np.int64), percent
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(int(found.sum()), region), pa.int64()),
                pa.array(np.array(nodes, np.int64)[found]),
                pa.array(np.array(groups, np.int64)[found]),
            ],
            names=["region", "node", "grp"],
        )

    return _by_region(("node", "n", "marks", "grp"), solve)


def _linked(percent: int) -> Callable:
    def solve(
        region: int, nodes: tuple, sizes: tuple, marks: tuple, groups: tuple, sets: tuple
    ) -> Iterator[pa.RecordBatch]:
        links = region_links(
            np.array(sizes, np.int64),
            _mark_table(marks),
            np.array(groups, np.int64),
            [np.frombuffer(s, np.uint64) for s in sets],
            percent,
        )
        ends = [sorted((nodes[i], nodes[j])) for i, j in links]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())],
            names=["a", "b"],
        )

    return _by_region(("node", "n", "marks", "grp", "shingles"), solve)


def _crowd_linked(percent: int) -> Callable:
    def solve(region: int, nodes: tuple, groups: tuple, sets: tuple) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(s) for s in found], np.int64)
        links = crowd_links(sizes, np.array(groups, np.int64), found, percent)
        ends = [sorted((nodes[i], nodes[j])) for i, j in links]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())],
            names=["a", "b"],
        )

    return _by_region(("node", "grp", "shingles"), solve)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of every set."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            found = [np.frombuffer(s.as_py(), np.int64) for s in part.column("shingles")]
            sizes = [len(f) for f in found]
            columns = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "grp")]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(np.concatenate(found))],
                names=["node", "grp", "shingle"],
            )


def _prefix(order: Column, depth: int) -> Column:
    """The first values of the signature read from the order's place on."""
    twice = F.concat("signature", "signature")
    return F.xxhash64(order, F.lit(depth), twice.substr(4 * order + 1, F.lit(4 * depth)))


def _regions(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(region, node) of regions with two documents and more, (a, b) of hubs, parted nodes.

    Where a region is split by depth, all its documents are also candidates with
    its hub, the set that most documents have, which connects most of what a
    longer prefix parts. Two documents that meet in no region here, but would
    without the split, are both among the parted nodes.
    """
    rows = classes.select(
        "node", "docs", "signature", F.explode(F.array(*map(F.lit, ORDERS))).alias("order")
    )
    done, hubs = [], []
    for depth in DEPTHS:
        keyed = rows.withColumn("region", _prefix(F.col("order"), depth))
        hub = F.max_by("node", F.struct("docs", -F.col("node"))).alias("hub")
        counts = (
            keyed.groupBy("region").agg(F.count("*").alias("held"), hub).where("held > 1")
        )
        found = settle(
            keyed.select("region", "node", "order").join(counts, "region")
        )
        over = found.where(F.col("held") > REGION)
        hubs.append(over.select(F.col("node").alias("a"), F.col("hub").alias("b")))
        if depth == DEPTHS[-1]:
            # Equal in every value: shares of a region of equals, joined by the hub.
            share = F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / REGION))
            region = F.when(F.col("held") > REGION, F.xxhash64("region", share))
            done.append(found.select(F.coalesce(region, "region").alias("region"), "node"))
            break
        done.append(found.where(F.col("held") <= REGION).select("region", "node"))
        if over.isEmpty():
            break
        rows = over.select("node", "order").join(
            classes.select("node", "docs", "signature"), "node"
        )
    regions, pairs = done[0], hubs[0]
    for more in done[1:]:
        regions = regions.unionAll(more)
    for more in hubs[1:]:
        pairs = pairs.unionAll(more)
    parted = hubs[0].select(F.col("a").alias("node")).distinct()
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return regions, pairs, parted


def _low_bytes() -> Column:
    """The last byte of every value: two values agree in it by chance once in 256."""
    return F.concat(*(F.col("signature").substr(4 * i + 4, 1) for i in range(VALUES)))


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``, ``text_hash``.

    Texts are lower-cased (A-Z) and split into words at ASCII white space; a
    document's set holds its distinct shingles of ``width`` words, with fewer
    words the whole text as one. Documents are linked when their sets share
    ``percent`` per cent of their union; ``component_id`` is the smallest id
    reachable over links, and the document with that id is ``kept``.

    A single pair exactly at the threshold is missed where no order makes its
    documents meet (3e-7 at 80 per cent, 2e-9 at 85) or where its signatures
    agree in fewer than ``least_agreement`` values (4e-6 at 80, 9e-6 at 85).
    The second does not hold for pairs that the split of a region has parted.

    A null text counts as empty; a document without words is linked with none.
    Equal sets are one node however many documents have them. A row without id
    takes part in links; it is kept only where its component holds no id at all.
    Rows with the same id in one component are kept or dropped alike. An empty
    table gives no rows; other columns are not read.
    """
    kind = type_of(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    signed = settle(
        rows.mapInArrow(
            _sign(width), f"id {kind}, k long, n_shingles long, set_key binary, signature binary"
        )
    )
    classes = settle(
        signed.where("n_shingles > 0")
        .groupBy("set_key", "signature", F.col("n_shingles").alias("n"))
        .agg(F.min("id").alias("first_id"), F.count("*").alias("docs"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    regions, hub_pairs, parted = _regions(classes)
    parted = settle(parted)
    marks = classes.select("node", "n", _low_bytes().alias("marks"))
    regions = settle(regions)

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        sorted_rows = rows.repartition("region").sortWithinPartitions("region", "node")
        return sorted_rows.select("region", "node", "n", "marks", *columns)

    placed = regions.join(marks, "node")
    near = dealt(placed).mapInArrow(_candidates(percent), "a long, b long, agreed int")
    hubs = hub_pairs.distinct().withColumn("agreed", F.lit(0))
    found = near.unionAll(hubs)
    candidates = settle(found.groupBy("a", "b").agg(F.max("agreed").alias("agreed")))
    sets = _candidate_sets(rows, classes, candidates, width)

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "sa", "sb")
        return settle(both.mapInArrow(_confirm(percent), "a long, b long"))

    # First every node's best candidate, then what these links leave apart.
    best = F.max(F.struct("agreed", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("p")
    ends = candidates.withColumn("node", F.explode(F.array("a", "b")))
    first = (
        ends.groupBy("node")
        .agg(best)
        .select((-F.col("p.x")).alias("a"), (-F.col("p.y")).alias("b"))
        .distinct()
    )
    tried = settle(first)
    links = confirmed(tried)
    groups = settle(partial_components(links, 2))
    rest = settle(_apart(candidates, groups).join(tried, ["a", "b"], "left_anti"))
    links = links.unionAll(confirmed(rest))
    groups = settle(connected_components(links))
    # Last, whatever else may be linked is compared where it lies: a crowd whose
    # members resemble each other too little for a link makes no rows of pairs.
    grouped = placed.join(groups.select("node", F.col("component").alias("grp")), "node", "left")
    grouped = dealt(grouped.withColumn("grp", F.coalesce("grp", "node")), "grp")
    left = settle(
        grouped.mapInArrow(_undecided(percent), "region long, node long, grp long")
    )
    if not left.isEmpty():
        whole = dealt(left.join(marks, "node").join(sets, "node"), "grp", "shingles")
        more = settle(whole.mapInArrow(_linked(percent), "a long, b long").distinct())
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = settle(connected_components(stars.unionAll(more)))
    if not parted.isEmpty():
        more = _parted_links(parted.join(sets, "node"), groups, percent, confirmed)
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = settle(connected_components(settle(stars.unionAll(more))))
    return _labelled(signed, classes, groups, id_col)


def _parted_links(
    sets: DataFrame, groups: DataFrame, percent: int, confirmed: Callable
) -> DataFrame:
    """Links between different groups of these nodes, by an exact join on whole sets.

    Shingles are ordered: first those in one group only, then by how many nodes
    hold them. Linked sets share one of their first ``n - percent n + 1``
    shingles, and one that several groups hold. Holders of a rare shingle are
    compared in pairs. Nodes connected through others form crowds; a crowd is
    dealt to shares, and each two shares meet in one task.
    """
    named = groups.select("node", F.col("component").alias("grp"))
    held = settle(
        sets.join(named, "node", "left").select(
            "node", F.coalesce("grp", "node").alias("grp"), "shingles"
        )
    )
    rows = settle(held.mapInArrow(_shingles, "node long, grp long, shingle long"))
    facts = settle(
        rows.groupBy("shingle")
        .agg(F.count("*").alias("held"), F.min("grp").alias("low"), F.max("grp").alias("high"))
        .where("low < high")
        .select("shingle", "held", F.col("held").alias("holders"))
    )
    total = F.lit(max(rows.count(), 1))
    shared = lookup_join(rows, facts, ["shingle"], "held", total).where("holders IS NOT NULL")
    size = F.floor(F.length("shingles") / 8).cast("long").alias("n")
    first = (
        shared.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("all"))
        .join(held.select("node", "grp", size), "node")
        .withColumn("least", F.expr(f"cast((n * {percent}L + 99) div 100 as int)"))
        # Those in one group only come first: n - size(all) of them.
        .withColumn("places", F.expr("size(all) - least + 1"))
        .where("places > 0")
        .select("node", "grp", "n", F.explode(F.expr("slice(all, 1, places)")).alias("s"))
        .select("node", "grp", "n", "s.shingle", "s.holders")
    )
    first = settle(first)
    rare = first.where(F.col("holders") <= RARE)
    one = rare.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "grp", "n")))
    other = rare.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "grp", "n")))
    fits = (
        (F.col("node_a") < F.col("node_b"))
        & (F.col("grp_a") != F.col("grp_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    )
    pairs = one.join(other, "shingle").where(fits)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    links = confirmed(settle(pairs))
    common = first.where(F.col("holders") > RARE)
    if common.isEmpty():
        return links
    leasts = settle(
        common.groupBy("shingle").agg(
            F.min("node").alias("b"), F.count("*").alias("held")
        )
    )
    edges = lookup_join(common.select("shingle", "node"), leasts, ["shingle"], "held", total)
    edges = settle(edges.select(F.col("node").alias("a"), "b").distinct())
    # A node of its own crowd has no other to be compared with.
    crowds = connected_components(edges).select("node", F.col("component").alias("crowd"))
    crowded = settle(crowds.join(held, "node"))
    several = crowded.groupBy("crowd").agg(
        F.count("*").alias("held"), F.min("grp").alias("low"), F.max("grp").alias("high")
    )
    several = settle(several.where("low < high").select("crowd", "held", F.col("held").alias("m")))
    shares = F.ceil(F.col("m") / REGION).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    met = (
        lookup_join(crowded, several, ["crowd"], "held", F.lit(max(crowded.count(), 1)))
        .where("m IS NOT NULL")
        .withColumn("shares", shares)
        .withColumn("own", own)
        .withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
        # Of several shares each meets the others; its own rows meet there too.
        .where("shares = 1 OR own != share")
        .withColumn("region", F.xxhash64("crowd", F.least("own", "share"), F.greatest("own", "share")))
    )
    met = met.select("region", "node", "grp", "shingles")
    met = met.repartition("region").sortWithinPartitions("region", "node")
    more = settle(met.mapInArrow(_crowd_linked(percent), "a long, b long").distinct())
    return links.unionAll(more)


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different groups."""
    ga = groups.select(F.col("node").alias("a"), F.col("component").alias("ga"))
    gb = groups.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    joined = pairs.select("a", "b").join(ga, "a", "left").join(gb, "b", "left")
    return joined.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")


def _candidate_sets(
    rows: DataFrame, classes: DataFrame, candidates: DataFrame, width: int
) -> DataFrame:
    """Whole shingle sets of all nodes that are candidates, from their texts."""
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = settle(
        nodes.join(classes.select("node", "set_key", "first_id"), "node").select(
            "node", "set_key", F.col("first_id").alias("wanted_id")
        )
    )
    texts = rows.join(few_rows(wanted), rows["id"].eqNullSafe(wanted["wanted_id"]))
    found = texts.select("node", "set_key", "text").mapInArrow(
        _sets(width), "node long, set_key binary, own_key binary, shingles binary"
    )
    # Ids may repeat over different texts.
    return settle(
        found.where("set_key = own_key").select("node", "shingles").dropDuplicates(["node"])
    )


def _labelled(
    signed: DataFrame, classes: DataFrame, groups: DataFrame, id_col: str
) -> DataFrame:
    joined = classes.select("node", "set_key", "first_id").join(groups, "node", "left")
    named = joined.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    keys = named.select("set_key", "component").join(least, "component").drop("component")
    found = signed.select("id", "k", "n_shingles", "set_key").join(keys, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.col("k").alias("text_hash"),
    )


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """The rows of ``docs`` that ``near_components`` keeps, all columns as they are.

    Nulls, repeats and empty tables are treated as there; columns may have any names.
    """
    found = near_components(docs, id_col, text_col, width, percent)
    gone = found.where("not kept").select(
        F.col(id_col).alias("gone_id"), F.col("text_hash").alias("gone_hash")
    )
    gone = few_rows(settle(gone.distinct()))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    # The caller's row is one column, so that its names meet none of these.
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text).alias("hash")
    )
    same = F.col("own").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")
