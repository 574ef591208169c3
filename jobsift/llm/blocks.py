"""Blocks of rows, and block-wise questions to keyed partitions.

Several operators need, for a block of some megabytes of documents, facts
about millions of words or windows that are spread over all other blocks.
Shuffling one row per word would cost far more than the words themselves, so a
block packs all it has to ask one key range into a single binary row:

``pack``      rows -> stored table (block, n_rows, n_bytes, payload)
``ask``       blocks -> rows (block, part, payload), one per block and part
``answer``    rows of one part together -> rows (block, part, payload)
``apply``     each block with the answers to its questions -> rows

Spark deals, shuffles and retries the rows; numpy works inside a task.  A task
holds one block, or the questions to one part: both are bounded by the
parameters ``target`` and ``parts``, not by the size of a key, because a block
asks about each distinct key once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.session import ensure_checkpoint_dir

TARGET = 6 << 20
ASKED = "block long, part long, payload binary"


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver has
    it.  A cluster gets it by ``--py-files`` or on its machines."""
    if spark.sparkContext.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: the
    lineage ends at files that every executor can read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that a later one has replaced."""
    spark = df.sparkSession
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def part_count(spark: SparkSession) -> int:
    """Key ranges: twice the shuffle partitions, so that hashing them to
    partitions stays even."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, target: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``target`` bytes at most (a
    single longer row stays whole)."""
    if batch.num_rows <= 1 or batch.nbytes <= target:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), target)
    yield from slices(batch.slice(half), target)


def _dump(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batches[0].schema, options=options) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def pack(df: DataFrame, target: int = TARGET,
         dump: Callable[[list[pa.RecordBatch]], bytes] = _dump) -> DataFrame:
    """Rows in blocks of about ``target`` bytes, compressed and stored.  The
    block number is written with the block, so later jobs agree on it.  ``dump``
    may store something else than the rows as they are, as a table."""

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()),
                "n_rows": pa.array([sum(b.num_rows for b in held)], pa.int64()),
                "n_bytes": pa.array([size], pa.int64()),
                "payload": pa.array([dump(held)], pa.binary())})

        for batch in batches:
            for s in slices(batch, target):
                if held and size + s.nbytes > target:
                    yield row()
                    block, held, size = block + 1, [], 0
                held.append(s)
                size += s.nbytes
        if held:
            yield row()

    return stored(df.mapInArrow(run, "block long, n_rows long, n_bytes long, payload binary"), "blocks")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of small tables of large binaries, one at a time."""
    for b in batches:
        columns = b.columns
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _asked(block: int, got: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block] * len(got), pa.int64()),
        "part": pa.array([p for p, _ in got], pa.int64()),
        "payload": pa.array([x for _, x in got], pa.binary())})


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    def run(batches):
        for block, payload in rows_of(batches):
            got = list(question(block, load(payload)))
            if got:
                yield _asked(block, got)

    return blocks.select("block", "payload").mapInArrow(run, ASKED)


def by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key side by side in one partition."""
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order)


def grouped(rows: Iterable[tuple], at: int) -> Iterator[tuple[int, list[tuple]]]:
    key, held = None, []
    for r in rows:
        if held and r[at] != key:
            yield key, held
            held = []
        key = r[at]
        held.append(r)
    if held:
        yield key, held


def answer(asked: DataFrame, reply: Callable[[int, list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """``reply(part, [(block, question)])`` -> ``[(block, answer)]``."""

    def run(batches):
        for part, rows in grouped(rows_of(batches), 1):
            for block, x in reply(part, [(b, p) for b, _, p in rows]):
                yield _asked(block, [(part, x)])

    return by_key(asked, "part", "block").mapInArrow(run, ASKED)


def apply(blocks: DataFrame, answers: DataFrame,
          fn: Callable[[int, pa.Table, dict[int, bytes]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``fn(block, rows, {part: answer})`` for each block."""
    both = blocks.select("block", F.lit(-1).cast("long").alias("part"), "payload").unionByName(
        answers.select("block", "part", "payload"))

    def run(batches):
        for block, rows in grouped(rows_of(batches), 0):
            yield from fn(block, load(rows[0][2]), {p: x for _, p, x in rows[1:]})

    return by_key(both, "block", "part").mapInArrow(run, schema)


def ask_of(blocks: DataFrame, answers: DataFrame,
           question: Callable[[int, pa.Table, dict[int, bytes]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """A second question of each block, made with the answers to the first."""

    def fn(block, table, got):
        out = list(question(block, table, got))
        if out:
            yield _asked(block, out)

    return apply(blocks, answers, fn, ASKED)


def texts_of(table: pa.Table, column: str = "text") -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return table.column(column).cast(pa.binary()).to_pylist()


def ranges(parts: int, keys: np.ndarray) -> np.ndarray:
    """Bounds of the key ranges within sorted unsigned 64-bit keys."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def small(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest unsigned type."""
    most = int(a.max()) if len(a) else 0
    for kind in (np.uint8, np.uint16, np.uint32):
        if most <= np.iinfo(kind).max:
            return a.astype(kind)
    return a.astype(np.uint64)


def with_columns(schema, new: str):
    """Schema of a table after ``new`` columns are added; a column of the
    input that has a new column's name gives way to it."""
    from pyspark.sql.types import StructType
    added = StructType.fromDDL(new)
    return StructType([f for f in schema.fields if f.name not in added.names] + added.fields)


def add_columns(table: pa.Table, new: dict[str, pa.Array]) -> list[pa.RecordBatch]:
    keep = [c for c in table.column_names if c not in new]
    out = table.select(keep)
    for name, values in new.items():
        out = out.append_column(name, values)
    return out.combine_chunks().to_batches()
