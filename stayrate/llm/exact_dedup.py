"""Exact duplicates by Grace hashing over complete contents.

1. Every task reads its rows once and combines equal contents in an
   open-addressing table, so that a content repeated any number of times leaves
   a task once per table.
2. These representatives are dealt out by content hash. A task keeps them in
   the same kind of table; once its contents pass the memory bound, table and
   input are split into spill files by the next bits of the hash, and each file
   is treated the same way, as deep as needed.
3. Rows learn the outcome through their representative's number, a key that no
   task shares, so that a content held by a third of the rows is no hot key.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import type_of
from stayrate.session import settle

UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())
FAN_BITS = 4
HASH_BITS = 64


class ContentTable:
    """Open addressing with linear probing; equality is decided by the whole content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.size = 0

    def place(self, number: int, content: bytes) -> tuple[int, bool]:
        """Index of the content, and whether it is new."""
        mask = len(self.slots) - 1
        at = number & mask
        while (index := self.slots[at]) >= 0:
            if self.hashes[index] == number and self.contents[index] == content:
                return index, False
            at = (at + 1) & mask
        index = len(self.contents)
        self.slots[at] = index
        self.hashes.append(number)
        self.contents.append(content)
        self.values.append([])
        self.size += len(content) + 200
        if 3 * index > 2 * mask:
            self._grow()
        return index, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for index, number in enumerate(self.hashes):
            at = number & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = index


def _better(a: tuple, b: tuple) -> bool:
    """Does row (id, row number) ``a`` stay rather than ``b``? Null ids come last."""
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] < b[1]


def _combine(schema: pa.Schema, memory: int) -> Callable:
    """Rows, and one representative for every content of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        found, first, row = ContentTable(), base, base

        def representatives() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(found.contents), 512):
                some = range(start, min(start + 512, len(found.contents)))
                best = [found.values[i][0] for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(some), schema.field("id").type),
                        pa.nulls(len(some), pa.int64()),
                        pa.array([first + i for i in some], pa.int64()),
                        pa.nulls(len(some), pa.string()),
                        pa.array([found.contents[i] for i in some], pa.binary()),
                        pa.array([found.hashes[i] - (1 << 63) for i in some], pa.int64()),
                        pa.array([b[0] for b in best], schema.field("best_id").type),
                        pa.array([b[1] for b in best], pa.int64()),
                        pa.array([found.values[i][1] for i in some], pa.int64()),
                    ],
                    schema=schema,
                )

        for batch in batches:
            reps, digests, numbers = [], [], []
            ids = batch.column("id").to_pylist()
            for identity, text in zip(ids, batch.column("text")):
                content = (text.as_py() or b"").translate(FOLD)
                digest = hashlib.sha256(content)
                index, new = found.place(int.from_bytes(digest.digest()[:8], "big"), content)
                value, mine = found.values[index], (identity, row)
                if new:
                    value += [mine, 1]
                else:
                    value[1] += 1
                    if _better(mine, value[0]):
                        value[0] = mine
                reps.append(first + index)
                digests.append(digest.hexdigest())
                numbers.append(row)
                row += 1
                if found.size > memory:
                    yield from representatives()
                    first += len(found.contents)
                    found = ContentTable()
            size = len(reps)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(numbers, pa.int64()),
                    pa.array(reps, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.nulls(size, pa.binary()),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, schema.field("best_id").type),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.int64()),
                ],
                schema=schema,
            )
        yield from representatives()

    return run


def grace_groups(records: Iterator[tuple], memory: int, level: int = 0) -> Iterator[tuple]:
    """Groups of equal contents, in bounded memory.

    ``records`` are (hash, content, representatives, best row, count). Yields
    (representatives, best row, count) once for each content.
    """
    found, deepest = ContentTable(), (level + 1) * FAN_BITS > HASH_BITS
    files: list | None = None

    def spill(record: tuple) -> None:
        bucket = (record[0] >> (HASH_BITS - FAN_BITS * (level + 1))) & ((1 << FAN_BITS) - 1)
        pickle.dump(record, files[bucket], protocol=5)

    for record in records:
        if files is not None:
            spill(record)
            continue
        number, content, reps, best, count = record
        index, new = found.place(number, content)
        value = found.values[index]
        if new:
            value += [list(reps), best, count]
        else:
            value[0] += reps
            value[2] += count
            if _better(best, value[1]):
                value[1] = best
        if found.size > memory and not deepest and len(found.contents) > 1:
            # Unlinked files: nothing is left behind when a task is lost.
            files = [tempfile.TemporaryFile() for _ in range(1 << FAN_BITS)]
            for i, (reps, best, count) in enumerate(found.values):
                spill((found.hashes[i], found.contents[i], reps, best, count))
            found = ContentTable()
    for reps, best, count in found.values:
        yield reps, best, count
    del found
    for file in files or ():
        with file:
            file.seek(0)
            yield from grace_groups(_read(file), memory, level + 1)


def _read(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _resolve(schema: pa.Schema, memory: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c) for c in ("h", "content", "rep")]
                best = zip(batch.column("best_id").to_pylist(), batch.column("best_row").to_pylist())
                for h, content, rep, top, n in zip(*columns, best, batch.column("n").to_pylist()):
                    yield h.as_py() + (1 << 63), content.as_py(), [rep.as_py()], top, n

        rows: list[tuple] = []
        for reps, best, count in grace_groups(records(), memory):
            for rep in reps:
                rows.append((rep, *best, count))
                if len(rows) == 8192:
                    yield _batch(rows, schema)
                    rows = []
        yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 64 << 20
) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty. Of a group the row with the largest id stays; null ids come after
    all others, and of rows with the same id exactly one stays. An empty table
    gives no rows; other columns are not read, whatever their names.
    ``memory`` bounds the contents that a task holds at a time, but for a
    single content beyond it.
    """
    kind = type_of(docs, id_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"{id_col} must be an integer or a string, not {kind}")
    combined = pa.schema(
        [
            ("id", id_type),
            ("row", pa.int64()),
            ("rep", pa.int64()),
            ("text_sha256", pa.string()),
            ("content", pa.binary()),
            ("h", pa.int64()),
            ("best_id", id_type),
            ("best_row", pa.int64()),
            ("n", pa.int64()),
        ]
    )
    local = settle(
        rows.mapInArrow(
            _combine(combined, memory),
            f"id {kind}, row long, rep long, text_sha256 string, content binary, h long, "
            f"best_id {kind}, best_row long, n long",
        )
    )
    solved = pa.schema(
        [("rep", pa.int64()), ("keep_id", id_type), ("keep_row", pa.int64()), ("size", pa.int64())]
    )
    groups = (
        local.where("content is not null")
        .select("rep", "content", "h", "best_id", "best_row", "n")
        .repartition("h")
        .mapInArrow(_resolve(solved, memory), f"rep long, keep_id {kind}, keep_row long, size long")
    )
    return (
        local.where("row is not null")
        .select("id", "row", "rep", "text_sha256")
        .join(groups, "rep")
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("size").alias("group_size"),
            (F.col("row") == F.col("keep_row")).alias("kept"),
            "text_sha256",
        )
    )
