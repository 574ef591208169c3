"""Token ids, packed into rows of a fixed length.

Best-fit decreasing: the pieces of a group of documents are placed from the
longest to the shortest, each into the open row with the least room that still
holds it; a segment tree over the amounts of room finds that row.  A document
longer than a row is cut into whole rows and a rest, so no id is lost.

A group is a run of documents of one task, of about ``GROUP`` ids: packing needs
no shuffle, and memory is bounded by the group.  Output rows carry the id matrix
row as little-endian binary, the cumulative segment lengths, the places where
positions restart, and which part of which document each segment is.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into the pieces that are encoded on their own (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the pattern's last two branches take; longer runs of it than
#: RUN are taken out before the pattern's look-ahead would go through them.
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RUN = 20_000
END = 50256
LENGTH = 2048
GROUP = 4_000_000
SCHEMA = ("pack long, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
          "segments array<struct<id:{0},part:int,length:int>>")


class Room:
    """Open rows by the room left in them: a segment tree over 0 .. length
    finds the least room of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = True
            node >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Row with the least room >= n, and that room."""
        node = n + self.leaves
        if not self.any[node]:
            while True:
                if node == 1:
                    return None
                if not node & 1 and self.any[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = False
            while node > 1 and not self.any[node ^ 1]:
                node >>= 1
                self.any[node] = False
        return row, room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; no row holds more than ``length``."""
    room, rows = Room(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        got = room.take(n)
        if got is None:
            rows.append([])
            got = len(rows) - 1, length
        rows[got[0]].append(i)
        if got[1] > n:
            room.put(got[1] - n, got[0])
    return rows


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_LONG_RUN = re.compile(SPACES + "{%d,}" % RUN)


def encode(encoding, text: str) -> list[int]:
    """Ids of a text.  A run of white space is one piece of the pattern up to its
    last character, which goes with what follows; at the end of a text it is one
    piece whole.  Long runs are encoded as such a piece, with the same ids."""
    ids, at = [], 0
    for m in _LONG_RUN.finditer(text) if len(text) >= RUN else ():
        cut = m.end() if m.end() == len(text) else m.end() - 1
        ids += encoding.encode_ordinary(text[at:m.start()])
        ids += encoding._encode_single_piece(text[m.start():cut])
        at = cut
    return ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def pack_ids(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
             length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Rows of ``length`` ids: ``pack`` and ``row``, ``n_tokens`` (the rest of
    ``ids`` is filled with the end id), ``ids`` (unsigned 16-bit, little-endian),
    ``cu_seqlens`` (0 and each segment's end), ``resets`` (each segment's start,
    where positions begin at 0 again) and ``segments`` (document id, part from 0,
    length), in the row's order.

    Each document is its ids and one end id; a null or empty text is the end id
    alone.  A longer document than a row is cut into whole rows and a rest.
    Repeated rows and ids are packed one by one; an empty table gives an empty
    result; other columns are left out.  ``decoded`` restores the texts.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    if length < 1 or max(ranks.value.values()) >= END:
        raise ValueError("a row holds at least one id, and the end id must be free")

    def run(batches):
        import tiktoken
        from pyspark import TaskContext
        encoding = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        pack = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for b in B.slices(batch, B.TARGET):
                for i, t in zip(b.column(id_col), b.column(text_col).to_pylist()):
                    ids = np.array([*(encode(encoding, t) if t else ()), END], np.uint16)
                    held.append((i.as_py(), ids))
                    size += len(ids)
                    if size >= group:
                        yield _packed(pack, held, length, id_type)
                        pack, held, size = pack + 1, [], 0
        if held:
            yield _packed(pack, held, length, id_type)

    id_type = _arrow_type(docs, id_col)
    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(kind))


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema[column].dataType)


def _packed(pack: int, held: list[tuple], length: int, id_type: pa.DataType) -> pa.RecordBatch:
    pieces = [(d, part, ids[at:at + length]) for d, ids in held for part, at in enumerate(range(0, len(ids), length))]
    rows = best_fit([len(x) for _, _, x in pieces], length)
    ends = [np.append(0, np.cumsum([len(pieces[i][2]) for i in row])).astype(np.int32) for row in rows]
    matrix = np.full((len(rows), length), END, "<u2")
    for n, row in enumerate(rows):
        flat = np.concatenate([pieces[i][2] for i in row])
        matrix[n, :len(flat)] = flat
    return pa.RecordBatch.from_pydict({
        "pack": pa.array([pack] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int32()),
        "n_tokens": pa.array([int(e[-1]) for e in ends], pa.int32()),
        "ids": pa.array([m.tobytes() for m in matrix], pa.binary()),
        "cu_seqlens": pa.array([e.tolist() for e in ends], pa.list_(pa.int32())),
        "resets": pa.array([e[:-1].tolist() for e in ends], pa.list_(pa.int32())),
        "segments": pa.array(
            [[{"id": pieces[i][0], "part": pieces[i][1], "length": len(pieces[i][2])} for i in row] for row in rows],
            pa.list_(pa.struct([("id", id_type), ("part", pa.int32()), ("length", pa.int32())])))})


def position_ids() -> Column:
    """Positions of a row's ids: they restart at each segment."""
    return F.flatten(F.transform("segments", lambda s: F.sequence(F.lit(0), s["length"] - 1)))


def decoded(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of every packed document: segments are cut out, put together by
    part and decoded; the end id goes.  Ids must not be repeated: the parts of two
    documents of one id can't be told apart, so such an id raises."""
    texts = packed.sparkSession.sparkContext.broadcast({i: b for b, i in read_vocabulary(vocabulary).items()})
    parts = packed.select(F.posexplode("segments").alias("n", "s"), "ids", "cu_seqlens").select(
        "s.id", "s.part", F.expr("substring(ids, 2 * cu_seqlens[n] + 1, 2 * s.length)").alias("x"))
    whole = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("p"))

    def run(batches):
        for b in batches:
            if any([x["part"] for x in p] != list(range(len(p))) for p in b.column("p").to_pylist()):
                raise ValueError("documents of the same id can't be told apart")
            out = [b"".join(texts.value[i] for x in p for i in np.frombuffer(x["x"], "<u2").tolist() if i != END)
                   for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "text": pa.array(out, pa.binary()).cast(pa.string())})

    return whole.mapInArrow(run, f"id {packed.schema['segments'].dataType.elementType['id'].dataType.simpleString()}, text string")


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
