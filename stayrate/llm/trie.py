"""Prefix trie of conversations, in balanced parentheses per shard.

A node of the trie is a sequence of first turns that some conversation has. Nodes
on a run without branch or end have the same conversations and make one edge; the
edges, in the order of their paths, are cut into shards. A shard is a bit string
with an opening and a closing parenthesis per edge, over which blocks keep the
least and greatest excess: findclose gives an edge's subtree, the rank of leaf pairs
its leaves, and the difference of cumulative savings what it saves. The ancestors
of a shard's first edge stand at its front as a spine; what shards say of the same
edge is added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.operators.skew import lookup_join
from stayrate.session import release, settle

#: Conversations in a family share the opening of their first one.
FAMILY = 5
#: Shared openings have fewer turns than this.
OPENINGS = 9
#: Edges of a shard; children of a block of excesses; queries answered at once.
SHARD = 65_536
FANOUT = 64
AT_ONCE = 16_384
#: Conversation ids in one piece of text.
PIECE = 4096
#: Characters of an edge's name in a path.
NAME = 32
#: Running sums of hashes are taken modulo this, so that adding two cannot overflow.
MODULUS = 1 << 61


class Parentheses:
    """Balanced parentheses with least and greatest excess per block."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.least, self.most = [excess], [excess]
        while len(self.least[-1]) > 1:
            starts = np.arange(0, len(self.least[-1]), FANOUT)
            self.least.append(np.minimum.reduceat(self.least[-1], starts))
            self.most.append(np.maximum.reduceat(self.most[-1], starts))
            if len(starts) == 1:
                break
        leaf = np.zeros(len(bits), np.int64)
        leaf[:-1] = bits[:-1] & ~bits[1:]
        self.pairs = np.concatenate([[0], np.cumsum(leaf)])

    def _within(
        self, level: int, start: np.ndarray, target: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """First place from ``start`` to the end of its block that holds the target."""
        least, most = self.least[level], self.most[level]
        end = np.minimum((start // FANOUT + 1) * FANOUT, len(least))
        places = start[:, None] + np.arange(FANOUT)
        inside = places < end[:, None]
        places = np.minimum(places, len(least) - 1)
        hit = inside & (least[places] <= target[:, None]) & (target[:, None] <= most[places])
        return hit.any(axis=1), start + hit.argmax(axis=1)

    def _forward(self, level: int, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        found, place = self._within(level, start, target)
        left = np.flatnonzero(~found)
        if len(left):
            block = self._forward(level + 1, start[left] // FANOUT + 1, target[left])
            place[left] = self._within(level, block * FANOUT, target[left])[1]
        return place

    def find_close(self, opening: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those opened at the given places."""
        out = np.empty(len(opening), np.int64)
        for at in range(0, len(opening), AT_ONCE):
            some = opening[at : at + AT_ONCE]
            out[at : at + AT_ONCE] = self._forward(0, some + 1, self.least[0][some] - 1)
        return out

    def leaf_pairs(self, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """Number of pairs () from an opening to its closing parenthesis."""
        return self.pairs[closing] - self.pairs[opening]


def encode_shard(
    paths: Sequence[str], weights: Sequence[int], last_has_children: bool
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of a shard's edges, spine first, with their leaves and savings in the shard.

    Paths are names of NAME characters each, in ascending order, so that an
    ancestor comes before its descendants. Children of the last edge that lie in
    later shards are held open by a pair that counts for nothing.
    """
    first = paths[0]
    above = [first[:k] for k in range(0, len(first), NAME)]
    items = [*above, *paths]
    levels = np.array([len(p) // NAME for p in items], np.int64)
    saved = np.array([0] * len(above) + list(weights), np.int64)
    if last_has_children:
        levels = np.append(levels, levels[-1] + 1)
        saved = np.append(saved, 0)
    # Before an item there are as many openings as items, and all but its level closed.
    opening = 2 * np.arange(len(levels)) - levels
    bits = np.zeros(2 * len(levels), np.uint8)
    bits[opening] = 1
    trie = Parentheses(bits.astype(bool))
    held = len(items)
    closing = trie.find_close(opening[:held])
    leaves = trie.leaf_pairs(opening[:held], closing)
    if last_has_children:
        leaves -= closing > opening[-1]
    totals = np.concatenate([[0], np.cumsum(saved)])
    inside = (closing - opening[:held] + 1) // 2
    at = np.arange(held)
    return [p[-NAME:] for p in items], leaves, totals[at + inside] - totals[at]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, leaves, saved) of each shard; edges come sorted by path."""
    paths: list[str] = []
    weights: list[int] = []
    children = 0

    def shard() -> Iterator[pa.RecordBatch]:
        names, leaves, saved = encode_shard(paths, weights, children > 0)
        for at in range(0, len(names), 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[part]), pa.array(leaves[part]), pa.array(saved[part])],
                names=["name", "leaves", "saved"],
            )

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("path", "weight", "children")))
        for path, weight, kids in rows:
            if len(paths) == SHARD:
                yield from shard()
                paths, weights = [], []
            paths.append(path)
            weights.append(weight)
            children = kids
    if paths:
        yield from shard()


def _cumulate(sums: Sequence[str], modulus: Sequence[int]) -> Callable:
    """Running totals per conversation inside one partition, and a row on its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = conv = None
        carried = np.zeros(len(sums), np.int64)
        like = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c").to_numpy()
            if first is None:
                first = int(c[0])
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            group = np.cumsum(new) - 1
            begins = np.flatnonzero(new)
            continues = conv == int(c[0])
            columns = []
            for i, (name, mod) in enumerate(zip(sums, modulus)):
                values = batch.column(name).to_numpy().astype(np.uint64)
                total = np.cumsum(values, dtype=np.uint64)
                before = (total - values)[begins]
                if continues:
                    before[0] -= np.uint64(carried[i])
                found = (total - before[group]) % np.uint64(mod)
                carried[i] = found[-1]
                columns.append(pa.array(found.astype(np.int64)))
            conv = int(c[-1])
            size = batch.num_rows
            more = [
                pa.array(np.full(size, part, np.int32)),
                pa.array(c == first),
                pa.nulls(size, pa.int64()),
                *columns,
            ]
            names = [*batch.schema.names, "part", "leading", "opened", *(f"run_{s}" for s in sums)]
            like = pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)
            yield like
        if like is not None:
            # The partition's last conversation, its totals, and its first conversation.
            end = {f.name: pa.nulls(1, f.type) for f in like.schema}
            end |= {
                "c": pa.array([conv], pa.int64()),
                "part": pa.array([part], pa.int32()),
                "opened": pa.array([first], pa.int64()),
            }
            end |= {f"run_{s}": pa.array([int(v)], pa.int64()) for s, v in zip(sums, carried)}
            yield pa.RecordBatch.from_pydict(end, schema=like.schema)

    return run


def running_totals(rows: DataFrame, order: list[Column], sums: dict[str, int]) -> DataFrame:
    """``rows`` with ``run_<name>``: totals in order inside each conversation ``c``.

    ``sums`` gives a modulus to each summed column, whose values are not
    negative and below it. Rows are dealt by ranges of conversation and order, so
    that a conversation of any length is cut; each range is totalled by itself,
    and a conversation's totals in earlier ranges are added. There is one such
    offset a range.
    """
    spark = rows.sparkSession
    names = list(sums)
    kept = [c for c in rows.columns if not c.startswith("order_")]
    keyed = rows.withColumns({f"order_{i}": c for i, c in enumerate(order)})
    keyed = keyed.withColumn("order_row", F.monotonically_increasing_id())
    keys = ["c", *(f"order_{i}" for i in range(len(order))), "order_row"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*kept)
    fields = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    more = "".join(f", run_{s} long" for s in names)
    local = settle(
        dealt.mapInArrow(
            _cumulate(names, list(sums.values())),
            f"{fields}, part int, leading boolean, opened long{more}",
        )
    )
    runs = [f"run_{s}" for s in names]
    ends = local.where("opened IS NOT NULL").select("part", "c", "opened", *runs)
    offsets, conv, carried = [], None, [0] * len(names)
    for part, last, opened, *totals in ends.orderBy("part").collect():
        if conv == opened:
            offsets.append((part, *carried))
        whole = last == opened == conv
        carried = [
            (t + (o if whole else 0)) % m for t, o, m in zip(totals, carried, sums.values())
        ]
        conv = last
    schema = "part int" + "".join(f", add_{s} long" for s in names)
    added = F.broadcast(spark.createDataFrame(offsets, schema))
    joined = local.where("opened IS NULL").join(added, "part", "left")
    total = {}
    for s, m in sums.items():
        more = F.when(F.col("leading"), F.coalesce(f"add_{s}", F.lit(0))).otherwise(0)
        total[f"run_{s}"] = (F.col(f"run_{s}") + more) % m
    found = settle(joined.withColumns(total).select(*kept, *runs))
    release(local)
    return found


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node joined into pieces; rows come sorted by node and id."""
    out: list[tuple] = []
    held: list[int] = []
    at: tuple | None = None

    def flush() -> None:
        if held:
            out.append((*at, held[0], ",".join(map(str, held))))
            held.clear()

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["depth", "sa", "sb", "first", "ids"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("depth", "sa", "sb", "c")))
        for *key, c in rows:
            if tuple(key) != at or len(held) == PIECE:
                flush()
                at = tuple(key)
            held.append(c)
        if out:
            yield batch_of()
    flush()
    if out:
        yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, one after the other; they come sorted."""
    at = state = None

    def row() -> pa.RecordBatch:
        values = [*at, state.hexdigest()]
        columns = [pa.array([v]) for v in values]
        return pa.RecordBatch.from_arrays(columns, names=["depth", "sa", "sb", "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "sa", "sb", "ids"))):
            if tuple(key) != at:
                if at is not None:
                    yield row()
                at, state = tuple(key), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if at is not None:
        yield row()


def _ends(convs: DataFrame, last: DataFrame) -> DataFrame:
    """``depth``, ``sa``, ``sb`` and ``ends_sha256`` of the nodes where conversations end."""
    key = ["depth", "sa", "sb"]
    zero = F.lit(0).cast("long")
    ends = convs.select("c").join(last, "c", "left").select(
        "c", *(F.coalesce(F.col(f"last.{k}"), zero).alias(k) for k in key)
    )
    dealt = ends.repartitionByRange(*key, "c").sortWithinPartitions(*key, "c")
    pieces = settle(
        dealt.mapInArrow(_pieces, "depth long, sa long, sb long, first long, ids string")
    )
    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids")
    return ordered.mapInArrow(_digests, "depth long, sa long, sb long, ends_sha256 string")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``c``, ``depth``, ``bytes``, ``ha``, ``hb``) of rebuilt turns, and all ``c``."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    # The role's length comes first, so that role and text cannot run into each other.
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = (
        conversations.select("c", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))
        .select(
            "c",
            F.octet_length("text").cast("long").alias("bytes"),
            F.xxhash64(F.lit(0), "digest").alias("a"),
            F.xxhash64(F.lit(1), "digest").alias("b"),
            F.lit(1).cast("long").alias("one"),
            F.col("turn").alias("order_turn"),
            F.col("role").alias("order_role"),
            F.col("text").alias("order_text"),
        )
    )
    order = [F.col("order_turn"), F.col("order_role"), F.col("order_text")]
    numbered = running_totals(turns, order, {"one": MODULUS}).withColumnRenamed("run_one", "p")
    opening = F.crc32(F.col("c").cast("string")) % OPENINGS
    convs = settle(
        numbered.groupBy("c")
        .agg(F.count("*").alias("turns"))
        .withColumns({"leader": F.col("c") - F.col("c") % FAMILY, "h": opening})
    )
    heads = (
        numbered.where((F.col("c") % FAMILY == 0) & (F.col("p") < OPENINGS))
        .select(F.col("c").alias("leader"), F.col("p").alias("depth"), "bytes", "a", "b")
        .join(convs.where("c != leader").select("c", "leader", "h"), "leader")
        .where("depth <= h")
        .select("c", "depth", "bytes", "a", "b")
    )
    leaders = convs.where("c = leader").select("leader", F.col("turns").alias("most"))
    shorter = settle(
        convs.where("c != leader")
        .join(leaders, "leader", "left")
        .withColumn("shift", F.least("h", F.coalesce("most", F.lit(0))) - F.col("h"))
        .where("shift < 0")
        .select("c", "shift", F.col("turns").alias("held"))
    )
    total = F.lit(convs.agg(F.sum("turns")).first()[0] or 0)
    own = lookup_join(numbered, shorter, ["c"], "held", total)
    own = own.where((F.col("c") % FAMILY == 0) | (F.col("p") > opening)).select(
        "c", (F.col("p") + F.coalesce("shift", F.lit(0))).alias("depth"), "bytes", "a", "b"
    )
    rebuilt = heads.unionByName(own).withColumns(
        {
            "ha": F.pmod(F.xxhash64("depth", "a", "b"), F.lit(MODULUS)),
            "hb": F.pmod(F.xxhash64("depth", "b", "a"), F.lit(MODULUS)),
        }
    )
    return rebuilt.select("c", "depth", "bytes", "ha", "hb"), convs


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node, the root included."""
    found = paths.groupBy("depth", "sa", "sb").agg(
        F.min("c").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("bytes").alias("bytes"),
        F.min("w").alias("w"),
        F.min("ha").alias("ha"),
        F.min("hb").alias("hb"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.withColumns({c: zero for c in ("depth", "sa", "sb", "bytes", "w", "ha", "hb")})
    return settle(found.unionByName(root))


def _edges(nodes: DataFrame) -> DataFrame:
    """Runs of nodes with the same conversations: ends, parent and children of each.

    Along the path of its smallest conversation the number of members falls from
    edge to edge, so the two name an edge.
    """
    step = F.struct("depth", "sa", "sb", "ha", "hb", (F.col("w") - F.col("bytes")).alias("w"))
    found = nodes.groupBy("conv_id", "n_convs").agg(
        F.min(step).alias("top"), F.max(F.struct("depth", "sa", "sb", "w")).alias("end")
    )
    above = {
        "up_depth": F.col("top.depth") - 1,
        "up_a": F.pmod(F.col("top.sa") - F.col("top.ha"), F.lit(MODULUS)),
        "up_b": F.pmod(F.col("top.sb") - F.col("top.hb"), F.lit(MODULUS)),
    }
    hexed = [F.lpad(F.hex(F.col(f"top.{k}")), NAME // 2, "0") for k in ("sa", "sb")]
    name = F.when(F.col("top.depth") == 0, "").otherwise(F.concat(*hexed))
    edges = settle(found.withColumns(above).withColumn("name", name))
    up = ["up_depth", "up_a", "up_b"]
    children = edges.where("up_depth >= 0").groupBy(*up).agg(F.count("*").alias("children"))
    own = F.struct("end.depth", "end.sa", "end.sb")
    parents = settle(
        edges.select(
            *(own[k].alias(u) for k, u in zip(("depth", "sa", "sb"), up)),
            F.col("conv_id").alias("parent_conv_id"),
            "name",
        ).join(children, up)
    )
    total = F.lit(edges.count())
    facts = parents.select(*up, "parent_conv_id", "children")
    placed = lookup_join(edges, facts, up, "children", total)
    found = settle(
        placed.join(parents.select("name", "children"), "name", "left").withColumn(
            "children", F.coalesce("children", F.lit(0))
        )
    )
    release(edges, parents)
    return found


def _paths(edges: DataFrame, paths: DataFrame, rows: int) -> DataFrame:
    """Every edge with ``path``, the names of the edges down to it.

    An edge lies on the path of its smallest conversation. Only edges of several
    conversations can be above another one, and every further one of them takes a
    longer conversation that leaves the path there.
    """
    several = settle(
        edges.where("n_convs > 1 AND top.depth > 0").select(
            F.col("top.depth").alias("depth"),
            F.col("top.sa").alias("sa"),
            F.col("top.sb").alias("sb"),
            F.col("n_convs").alias("held"),
            "name",
        )
    )
    keys = ["depth", "sa", "sb"]
    met = lookup_join(paths.select("c", *keys), several, keys, "held", F.lit(rows))
    lists = (
        met.where("name IS NOT NULL")
        .groupBy(F.col("c").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("listed"))
    )
    above = F.transform(
        F.filter("listed", lambda e: e["depth"] < F.col("top.depth")), lambda e: e["name"]
    )
    path = F.concat(F.coalesce(F.array_join(above, ""), F.lit("")), F.col("name"))
    weight = (F.col("n_convs") - 1) * (F.col("end.w") - F.col("top.w"))
    return edges.join(lists, "conv_id", "left").select(
        path.alias("path"), weight.alias("weight"), "children"
    )


def conversation_trie(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    A conversation c takes the first h turns of conversation c - c % 5 (all if it
    has fewer, none if it is absent), h being the CRC-32 of its decimal id modulo
    9, and then its own turns after its first h. The columns are ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, members but
    one times the bytes of the last text) and ``ends_sha256`` of the members that
    end in the node.

    Turns are in ascending order, nulls first, equal ones by role and text; null
    roles and texts are empty, and a repeated row is a turn of its own. Rows
    without id are left out. A conversation without turns is a member of the root
    alone. An empty table gives no rows; other columns are not read. Sequences
    are compared by 122-bit sums of hashes of SHA-256.
    """
    chosen = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    turns, convs = rebuilt_turns(chosen)
    sums = {"ha": MODULUS, "hb": MODULUS, "bytes": MODULUS}
    found = running_totals(turns, [F.col("depth")], sums)
    paths = found.withColumnsRenamed({"run_ha": "sa", "run_hb": "sb", "run_bytes": "w"})
    nodes = _nodes(paths, convs)
    edges = _edges(nodes)
    rows = paths.count()
    shards = _paths(edges, paths, rows).repartitionByRange("path").sortWithinPartitions("path")
    subtrees = (
        shards.mapInArrow(_encode, "name string, leaves long, saved long")
        .groupBy("name")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    last = paths.groupBy("c").agg(F.max(F.struct("depth", "sa", "sb")).alias("last"))
    ends = _ends(convs, last).select(
        F.struct("depth", "sa", "sb").alias("at"), "ends_sha256"
    )
    facts = settle(
        edges.withColumn("at", F.struct("end.depth", "end.sa", "end.sb"))
        .join(subtrees, "name")
        .join(ends, "at", "left")
        .select(
            "conv_id",
            "n_convs",
            F.col("top.depth").alias("first_depth"),
            F.col("end.depth").alias("last_depth"),
            F.col("top.w").alias("above"),
            "parent_conv_id",
            "children",
            "leaves",
            "saved",
            "ends_sha256",
            (F.col("end.depth") - F.col("top.depth") + 1).alias("held"),
        )
    )
    joined = lookup_join(nodes, facts, ["conv_id", "n_convs"], "held", F.lit(nodes.count()))
    bottom = F.col("depth") == F.col("last_depth")
    before = (F.col("n_convs") - 1) * (F.col("w") - F.col("bytes") - F.col("above"))
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first_depth"), F.col("conv_id"))
        .otherwise(F.col("parent_conv_id"))
        .alias("parent_conv_id"),
        "n_convs",
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - before).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(none)))
        .otherwise(F.lit(none))
        .alias("ends_sha256"),
    )
