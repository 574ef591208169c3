"""SentencePiece encoding with the N best segmentations, and decoding.

A text's piece lattice has an edge for every vocabulary piece at every place.
Its best segmentations come from two passes: a forward Viterbi pass gives the
best score of each prefix, and a backward A-star search from the end uses those
scores as its heuristic.  They are exact, so the search pops whole
segmentations in order of score.

No piece runs on past a space or a line break, so the lattice falls into
units (a word with its leading spaces) and the search is made on two levels.
Within a unit it runs over pieces; across the units of a text, over the ranks of
the units' segmentations.  Only the units whose second-best segmentations lose
least can differ in the N best of the text - N - 1 of them - so all other units
are one edge each.  The forward pass keeps the two best scores of a unit, and
units are remembered within a task, up to a fixed number.

Order is total: by score, then units differ as early in the text as possible;
within a unit, ties go to the smaller last piece id.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
UNITS = re.compile(r" *[^ \n]+|\n| +")
UNIT_LIMIT = 250_000
#: Units walked together, and characters beyond which a unit is walked alone.
AT_ONCE, LONG_UNIT = 10_000, 64
#: Scores at or below this mark pieces that the model never chooses by score.
NEVER = -1e8
NBEST = "array<struct<score:double,edits:array<struct<start:int,end:int,ids:array<int>>>>>"


@dataclass(frozen=True)
class Model:
    """Vocabulary of a model: what a task needs, small enough to broadcast."""

    ids: dict[str, int]  # piece with plain spaces -> id
    scores: list[float]
    texts: list[bytes]  # what each id stands for
    bytes_of: list[int]  # id of each byte piece
    unknown: float  # score of a character without a piece
    prefix: bool  # a space is put before the text
    longest: int
    starts: dict[str, tuple[float, int] | None]  # pieces, and (None) what only begins one

    @staticmethod
    def read(path: str = MODEL) -> Model:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, texts, at_byte = {}, [], [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i).replace("▁", " "), sp.get_score(i)
            scores.append(score)
            if sp.is_byte(i):
                at_byte[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.encode())
                ids[piece] = i
                if "\n" in piece or " " in piece.lstrip(" "):
                    raise ValueError(f"piece {piece!r} runs on past a word's end")
        if not any(at_byte):
            raise ValueError("the model has no byte pieces, so it can't be decoded without loss")
        low = min(s for p, i in ids.items() if (s := scores[i]) > NEVER)
        starts: dict = {p[:n]: None for p in ids for n in range(1, len(p))}
        starts |= {p: (scores[i], i) for p, i in ids.items()}
        return Model(ids, scores, texts, at_byte, low - 10, sp.encode("a", out_type=str)[0].startswith("▁"),
                     max(map(len, ids)), starts)

    def expand(self, labels) -> list[int]:
        """Piece ids; a character without a piece is its UTF-8 bytes."""
        out = []
        for x in labels:
            if x < len(self.scores):
                out.append(x)
            else:
                out += [self.bytes_of[b] for b in chr(x - len(self.scores)).encode()]
        return out


def edges(model: Model, unit: str) -> list[list[tuple[int, float, int]]]:
    """Edges into each place of a unit: (from, score, label).  The label is a
    piece id, or beyond the ids a character that has no piece."""
    ids, scores, n = model.ids, model.scores, len(unit)
    into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for a in range(n):
        for b in range(a + 1, min(n, a + model.longest) + 1):
            i = ids.get(unit[a:b])
            if i is not None:
                into[b].append((a, scores[i], i))
            elif b == a + 1:
                into[b].append((a, model.unknown, len(scores) + ord(unit[a])))
    return into


def two_best(model: Model, unit: str) -> tuple[float, float, list[int]]:
    """Forward pass over a unit's edges: best and second-best score of the
    whole, and the labels of the best."""
    starts, unknown, n = model.starts, model.unknown, len(unit)
    low = float("-inf")
    one, two, label, back = [0.0] + [low] * n, [low] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for a in range(n):
        x, y, b = one[a], two[a], a
        for b in range(a + 1, n + 1):
            piece = starts.get(unit[a:b], 0)
            if piece is None:
                if b > a + 1:
                    continue
                piece = (unknown, len(model.scores) + ord(unit[a]))
            elif not piece:
                if b > a + 1:
                    break
                piece = (unknown, len(model.scores) + ord(unit[a]))
            s, i = piece
            c = x + s
            if c > one[b] or c == one[b] and i < label[b]:
                two[b] = max(one[b], two[b], y + s)
                one[b], label[b], back[b] = c, i, a
            elif c > two[b]:
                two[b] = c
            if y + s > two[b]:
                two[b] = y + s
    labels, v = [], n
    while v:
        labels.append(label[v])
        v = back[v]
    return one[n], two[n], labels[::-1]


class Path:
    """Labels from a unit's end backwards, as the last one and a link to the
    path before it, so a path costs the same whatever its length.  Paths order
    as the tuples of their labels do; ``jump`` links far back (skew binary), so
    the place where two paths part is found in logarithmic time."""

    __slots__ = ("before", "label", "depth", "jump")

    def __init__(self, before: Path | None = None, label: int = -1):
        self.before, self.label = before, label
        if before is None:
            self.depth, self.jump = 0, self
        else:
            far = before.jump
            self.depth = before.depth + 1
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def cut(self, depth: int) -> Path:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.before
        return at

    def __lt__(self, other: Path) -> bool:
        a, b = self.cut(other.depth), other.cut(self.depth)
        if a is b:
            return self.depth < other.depth
        while a.before is not b.before:
            a, b = (a.before, b.before) if a.jump is b.jump else (a.jump, b.jump)
        return a.label < b.label

    def labels(self) -> list[int]:
        """From the unit's start on."""
        out, at = [], self
        while at.before is not None:
            out.append(at.label)
            at = at.before
        return out


def n_best(into: list, k: int) -> list[tuple[float, list[int]]]:
    """The k best paths from place 0 to the last, in order: forward Viterbi
    scores, then A-star from the end with them as the exact heuristic."""
    ahead = [0.0] + [float("-inf")] * (len(into) - 1)
    for v in range(1, len(into)):
        for u, s, _ in into[v]:
            if ahead[u] + s > ahead[v]:
                ahead[v] = ahead[u] + s
    heap: list = [(-ahead[-1], Path(), len(into) - 1, 0.0)]
    out: list = []
    seen = [0] * len(into)
    while heap and len(out) < k:
        total, path, v, done = heappop(heap)
        if not v:
            out.append((-total, path.labels()))
            continue
        seen[v] += 1
        if seen[v] > k:  # behind k others from here, so not among the k best
            continue
        for u, s, i in into[v]:
            heappush(heap, (-(ahead[u] + (s + done)), Path(path, i), u, s + done))
    return out


class Trie:
    """The vocabulary as a table of (state, character) -> state, for walking
    along many units at once."""

    def __init__(self, model: Model):
        self.model = model
        number = {"": 0} | {p: i for i, p in enumerate(model.starts, 1)}
        characters = sorted({c for p in model.starts for c in p})
        self.width = len(characters) + 1
        self.kind = np.full(0x110000, len(characters), np.int64)
        self.kind[[ord(c) for c in characters]] = np.arange(len(characters))
        keys = np.array([number[p[:-1]] * self.width + self.kind[ord(p[-1])] for p in model.starts])
        order = np.argsort(keys)
        self.keys, self.to = keys[order], order + 1
        piece = [x or (0.0, -1) for x in model.starts.values()]
        self.score = np.array([0.0] + [x for x, _ in piece])
        self.label = np.array([-1] + [i for _, i in piece])

    def edges(self, code: np.ndarray, left: np.ndarray):
        """Edges (from, length, score, label) of the lattices of units that lie
        one after the other; ``left``: characters of the unit from each place."""
        at, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        out = []
        for n in range(1, self.model.longest + 1):
            key = state * self.width + self.kind[code[at + n - 1]]
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[row] == key
            state = np.where(on, self.to[row], 0)
            piece = self.label[state] >= 0
            where = at[piece]
            out.append((where, np.full(len(where), n), self.score[state[piece]], self.label[state[piece]]))
            if n == 1:
                bare = at[~piece]
                out.append((bare, np.full(len(bare), 1), np.full(len(bare), self.model.unknown),
                            len(self.model.scores) + code[bare].astype(np.int64)))
            on &= left[at] > n
            at, state = at[on], state[on]
            if not len(at):
                break
        return [np.concatenate(x) for x in zip(*out)]

    def two_best(self, units: list[str]):
        """Of each unit the best and second-best score and the best ids (flat,
        with how many each has): the forward pass over all units' lattices, one
        place after the other, places of all units at once."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        unit, first = np.repeat(np.arange(len(units)), size), np.cumsum(size) - size
        at, length, score, label = self.edges(code, (first + size)[unit] - np.arange(len(code)))
        start = first + np.arange(len(units))  # a unit has one more place than characters
        source = at + unit[at]
        target = source + length
        order = np.lexsort((target, target - start[unit[at]]))
        source, target, score, label = (x[order] for x in (source, target, score, label))
        deep = np.cumsum(np.bincount((target - start[unit[at[order]]]), minlength=2))
        places = len(code) + len(units)
        one, two, back = np.full(places, -np.inf), np.full(places, -np.inf), np.zeros(places, np.int64)
        one[start] = 0.0
        for d in range(1, len(deep)):
            a, b = deep[d - 1], deep[d]
            to = target[a:b]
            group = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            count = np.diff(np.append(group, b - a))
            c = one[source[a:b]] + score[a:b]
            top = np.repeat(np.maximum.reduceat(c, group), count)
            tied = np.where(c == top, label[a:b], np.iinfo(np.int64).max)
            chosen = tied == np.repeat(np.minimum.reduceat(tied, group), count)
            node = to[group]
            one[node], back[node] = c[chosen], a + np.flatnonzero(chosen)
            two[node] = np.maximum.reduceat(np.maximum(np.where(chosen, -np.inf, c), two[source[a:b]] + score[a:b]), group)
        end = start + size
        found, now, alive, step = [], end.copy(), np.arange(len(units)), 0
        while len(alive):
            edge = back[now]
            found.append((alive, np.full(len(alive), step), label[edge]))
            now, step = source[edge], step + 1
            on = now != start[alive]
            alive, now = alive[on], now[on]
        of, steps, labels = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-steps, of))
        of, labels = of[order], labels[order]
        bare = np.flatnonzero(labels >= len(self.model.scores))
        for i, ids in reversed([(i, self.model.expand([x])) for i, x in zip(bare.tolist(), labels[bare].tolist())]):
            labels = np.concatenate((labels[:i], ids, labels[i + 1:]))
            of = np.concatenate((of[:i], np.full(len(ids), of[i]), of[i + 1:]))
        return one[end], two[end], labels.astype(np.int32), np.bincount(of, minlength=len(units))


class Units(dict):
    """unit -> number, with its best ids, its score and what its second-best
    segmentation loses; starts anew beyond ``UNIT_LIMIT`` units."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.trie = model, Trie(model)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends, self.scores, self.loss = array("i"), array("q", [0]), array("d"), array("d")
        self.ranked: dict[int, list] = {}

    def meet(self, texts: list[list[str]]) -> None:
        """Learn the units not met before: short ones together, long ones (of
        which a few would hold up all others) one by one."""
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self))
        for w in new:
            if len(w) > LONG_UNIT:
                score, second, labels = two_best(self.model, w)
                self._add([w], [score], [score - second], self.model.expand(labels), [0])
                self.ends[-1] = len(self.ids)
        new = sorted((w for w in new if len(w) <= LONG_UNIT), key=len)
        for at in range(0, len(new), AT_ONCE):
            one, two, ids, n = self.trie.two_best(new[at:at + AT_ONCE])
            self._add(new[at:at + AT_ONCE], one.tolist(), (one - two).tolist(), ids.tolist(), n.tolist())

    def _add(self, units: list[str], scores, loss, ids, counts) -> None:
        end = self.ends[-1]
        for w, n in zip(units, counts):
            self[w] = len(self)
            end += n
            self.ends.append(end)
        self.ids.extend(ids)
        self.scores.extend(scores)
        self.loss.extend(loss)

    def best_of(self, number: int, unit: str, k: int) -> list[tuple[float, list[int]]]:
        got = self.ranked.get(number)
        if got is None:
            got = self.ranked[number] = [
                (s, self.model.expand(x)) for s, x in n_best(edges(self.model, unit), k)]
        return got


def _text_best(units: Units, words: list[str], numbers: np.ndarray, loss: np.ndarray, ends: np.ndarray,
               score: float, k: int) -> list[dict]:
    """The k best segmentations of a text: its score, and the ranges of the
    best one's pieces that are replaced."""
    near = np.flatnonzero(np.isfinite(loss))
    if len(near) > k - 1:
        limit = np.partition(loss[near], k - 2)[k - 2]
        below = near[loss[near] < limit]
        near = np.sort(np.concatenate((below, near[loss[near] == limit][:k - 1 - len(below)])))
    ranked = [units.best_of(int(numbers[p]), words[p], k) for p in near.tolist()]
    into = [[]] + [[(v, s - r[0][0], rank) for rank, (s, _) in enumerate(r)] for v, r in enumerate(ranked)]
    out = []
    for lost, ranks in n_best(into, k):
        out.append({"score": score + lost, "edits": [
            {"start": int(ends[p]) - len(r[0][1]), "end": int(ends[p]), "ids": r[rank][1]}
            for p, r, rank in zip(near.tolist(), ranked, ranks) if rank]})
    return out


def _encoded(units: Units, texts: list[str | None], k: int):
    """ids (flat, with bounds) and the k best of each text."""
    words = [UNITS.findall(" " + t if units.model.prefix else t) if t else [] for t in texts]
    if len(units) > UNIT_LIMIT:
        units.forget()
    units.meet(words)
    numbers = [np.fromiter(map(units.__getitem__, w), np.int64, len(w)) for w in words]
    pool, pool_ends = np.array(units.ids, np.int32), np.array(units.ends)
    scores, loss = np.array(units.scores), np.array(units.loss)
    flat, bounds, best = [], [0], []
    for w, n in zip(words, numbers):
        size = pool_ends[n + 1] - pool_ends[n]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(n) else 0
        flat.append(pool[np.arange(total) + np.repeat(pool_ends[n] - ends + size, size)])
        bounds.append(bounds[-1] + total)
        best.append(_text_best(units, w, n, loss[n], ends, float(scores[n].sum()), k))
    return np.concatenate(flat) if flat else pool[:0], bounds, best


def _restored(pieces: list[bytes], ids: np.ndarray, skip: int) -> str:
    return b"".join(map(pieces.__getitem__, ids.tolist()))[skip:].decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", best: int = BEST,
           restored: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (the best segmentation) and ``nbest``: for each of
    the ``best`` best segmentations, in order, its score and ``edits``, the
    ranges [start, end) of ``ids`` that it replaces (none for the first).

    Segmentations are scored by the sum of the model's piece scores.  A null text
    has null ids and null ``nbest``; an empty one no pieces and one segmentation
    of score 0.  A text with fewer segmentations than ``best`` gets them all.
    White space is kept as it is.  ``restored`` names a column for the text that
    decoding the ids gives, made in the same task (``decode`` does it for stored
    ids).  Repeated rows are encoded alike; an empty
    table gives an empty result; input columns named ``ids`` or ``nbest`` are
    replaced.  Executors read the vocabulary from a broadcast, not from a file.
    """
    if best < 1:
        raise ValueError("at least one segmentation must be asked for")
    known = docs.sparkSession.sparkContext.broadcast(Model.read(model))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches):
        units = Units(known.value)
        for batch in batches:
            for b in B.slices(batch, B.TARGET // 2):
                texts = b.column(text_col).to_pylist()
                flat, bounds, found = _encoded(units, texts, best)
                null = np.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.append(null, False)), pa.array(flat))
                new = {"ids": ids, "nbest": pa.array([None if n else x for n, x in zip(null.tolist(), found)], kind)}
                if restored:
                    new[restored] = pa.array([None if n else _restored(units.model.texts, flat[x:y], units.model.prefix)
                                              for n, x, y in zip(null.tolist(), bounds, bounds[1:])], pa.string())
                yield from B.add_columns(pa.Table.from_batches([b]), new)

    extra = f", {restored} string" if restored else ""
    return docs.mapInArrow(run, B.with_columns(docs.schema, f"ids array<int>, nbest {NBEST}{extra}"))


def decode(df: DataFrame, model: str = MODEL, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``: pieces joined, byte pieces put
    together, the leading space taken off.  Null ids give a null text."""
    known = df.sparkSession.sparkContext.broadcast(Model.read(model))

    def run(batches):
        pieces, skip = known.value.texts, int(known.value.prefix)
        for batch in batches:
            for b in B.slices(batch, 2 * B.TARGET):
                text = [_restored(pieces, v.values.to_numpy(), skip) if v.is_valid else None for v in b.column(ids_col)]
                yield from B.add_columns(pa.Table.from_batches([b]), {to: pa.array(text, pa.string())})

    return df.mapInArrow(run, B.with_columns(df.schema, f"{to} string"))


def segmentation(rank: int) -> Column:
    """All ids of the segmentation at ``rank`` (from 0): the best one's, with
    its edits put in from the last to the first."""
    edits = F.reverse(F.get("nbest", rank)["edits"])
    return F.aggregate(edits, F.col("ids"), lambda ids, e: F.concat(
        F.slice(ids, 1, e["start"]), e["ids"], F.slice(ids, e["end"] + 1, F.size(ids))))


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, restored="decoded").select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "nbest",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
