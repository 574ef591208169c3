"""Scoring texts with a hierarchical Pitman-Yor language model.

Each distinct word of the training texts has a context restaurant of its own,
for the tokens that follow it; the first token of a text follows the end of the
one before, so texts begin in the restaurant of the end.  All context
restaurants share one parent, the restaurant of words, whose base is uniform
over the V training types and "unknown".

Customers are training tokens (and, in the parent, tables of the context
restaurants).  Their seating is sampled by Gibbs: in each sweep all customers of
a dish leave a restaurant and are seated again one by one, each joining a table
or opening one by the restaurant's rule given everyone else; as that rule alone
is a little off, a seating is drawn ``DRAWS`` times and Metropolis steps choose
among the draws.  ``TURNS`` shares of a part's dishes take turns.  Parts sweep
at the same time and tell each other their tables after each round, so within a
round they see each other's tables as they were.  Predictive probabilities are
averaged over samples.

Words are numbered by part (a hash range) and, within it, by falling count.
Texts become their tokens' numbers once, and are not read again.  A part has all
contexts of its words and their place in the parent; it keeps the customers of
a context in it, and hears from a group of parts, that of the context's word, how
many tables the restaurant has in all parts.  A block of documents sends a part one
entry per distinct (word, context) and gets back one, so a word in a third of
all texts costs no more.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B

STRENGTH = 1.0
#: Rounds of Gibbs sweeps; every sweep of the last round gives a sample.
ROUNDS, SWEEPS = 2, 2
TURNS, DRAWS = 2, 3
ONE_BY_ONE = 16
#: Dishes seated in plain numbers; arrays so short cost more than what they hold.
FEW = 4
SEED = 20
END = b""
STATE = B.ASKED + ", sums array<double>"


def _tokens(texts: pa.Array):
    """Sorted distinct word hashes, of each token its word's place among them, and
    the texts' numbers of tokens."""
    texts = texts.cast(pa.binary()).view(pa.string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    pieces = lists.flatten().dictionary_encode()
    number, words = pieces.indices.to_numpy(), pieces.dictionary.cast(pa.binary()).to_pylist()
    # next to white space at an end of a text stand empty pieces
    if END not in words:
        words.append(END)
    end = words.index(END)
    some, offsets = number != end, lists.offsets.to_numpy()
    ends = np.append(0, np.cumsum(some))[offsets[1:] - offsets[0]]
    flat = np.insert(number[some], ends, end)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[flat], np.diff(ends, prepend=0) + 1


def tokenised(batches: list[pa.RecordBatch], id_col: str, text_col: str) -> bytes:
    """A block with tokens in the place of texts."""
    table = pa.Table.from_batches(batches)
    hashes, word, counts = _tokens(table.column(text_col).combine_chunks())
    rows = pa.table({id_col: table.column(id_col), "__train": table.column("__train"),
                     "n_tokens": pa.array(counts), "__block": _of_block(len(counts), hashes, word)})
    return B._dump(rows.to_batches())


def _dump(*arrays: np.ndarray) -> bytes:
    """Non-negative integers, narrow and compressed byte by byte."""
    out = []
    for a in map(B.small, arrays):
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        out.append((a.dtype.str, len(planes), pa.compress(planes, "zstd", asbytes=True)))
    return pickle.dumps(out)


def _load(payload: bytes) -> list[np.ndarray]:
    out = []
    for kind, size, x in pickle.loads(payload):
        kind = np.dtype(kind)
        planes = np.frombuffer(pa.decompress(x, size, "zstd", asbytes=True), np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64))
    return out


def _of_block(rows: int, *arrays: np.ndarray) -> pa.Array:
    """A column that holds values of the whole block in its first row."""
    return pa.array([_dump(*arrays)] + [None] * (rows - 1), pa.binary())


def _held(table: pa.Table) -> list[np.ndarray]:
    return _load(table.column("__block")[0].as_py())


def _dealt(ids: np.ndarray, parts: int) -> np.ndarray:
    """Numbers of words, ordered by part and then by place in the part."""
    return ((ids - 1) % parts << 40) | (ids - 1) // parts


def _place(dealt: np.ndarray) -> np.ndarray:
    return dealt & ((1 << 40) - 1)


def _steps(ids: np.ndarray) -> np.ndarray:
    return np.diff(ids, prepend=0)


def _cuts(dealt: np.ndarray):
    """(part, from, to) of sorted dealt numbers."""
    owner, at = np.unique(dealt >> 40, return_index=True)
    yield from zip(owner.tolist(), at.tolist(), np.append(at, len(dealt))[1:].tolist())


def encode(packed: DataFrame, parts: int, id_col: str) -> DataFrame:
    """Stored blocks of id, ``__train``, ``n_tokens``, ``n_known``, ``base`` (the
    sum of log10(c + 0.5)) and, of the block, the distinct numbers of its words
    (from 1 for words of training texts, 0 for others) and of each token its place
    among them."""

    def question(block, table):
        words, word = _held(table)
        words = words.astype(np.uint64)
        train = np.repeat(table.column("__train").to_numpy(), table.column("n_tokens").to_numpy())
        n = np.bincount(word[train], minlength=len(words))
        at = B.ranges(parts, words)
        for p in range(parts):
            if at[p + 1] > at[p]:
                yield p, pickle.dumps((words[at[p]:at[p + 1]], B.small(n[at[p]:at[p + 1]])))

    def reply(number, asked):
        got = [pickle.loads(x) for _, x in asked]
        words, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        n = np.bincount(back, np.concatenate([g[1] for g in got])).astype(np.int64)
        place = np.empty(len(n), np.int64)
        place[np.argsort(-n, kind="stable")] = np.arange(len(n))
        ids = np.where(n > 0, place * parts + number + 1, 0)
        at = 0
        for (block, _), (here, _) in zip(asked, got):
            mine = back[at:at + len(here)]
            at += len(here)
            yield block, _dump(ids[mine], n[mine])

    def numbers(block, table, got):
        (_, word), counts = _held(table), table.column("n_tokens").to_numpy()
        told = [_load(got[p]) for p in sorted(got)]
        ids, c = (np.concatenate([t[i] for t in told]) for i in (0, 1))
        doc, n = np.repeat(np.arange(len(counts)), counts), len(counts)
        distinct, place = np.unique(ids, return_inverse=True)
        rows = pa.table({
            id_col: table.column(id_col), "__train": table.column("__train"),
            "n_tokens": pa.array(counts), "n_known": pa.array(np.bincount(doc, c[word] > 0, n).astype(np.int64)),
            "base": pa.array(np.bincount(doc, np.log10(c + 0.5)[word], n)),
            "__block": _of_block(n, _steps(distinct), place[word])})
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int64()), "payload": pa.array([B._dump(rows.to_batches())], pa.binary())})

    asked = B.answer(B.ask(packed, question), reply)
    return B.stored(B.apply(packed, asked, numbers, "block long, payload binary"), "numbers")


def _distinct(keys: np.ndarray, bound: int):
    """Sorted distinct keys (from 0, below ``bound``), and of each key its place
    among them; key and place are sorted as one number if they fit."""
    places = max(1, len(keys)).bit_length()
    if not len(keys) or bound.bit_length() + places > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << places | np.arange(len(keys)))
    at = both & ((1 << places) - 1)
    both >>= places
    new = np.append(True, both[1:] != both[:-1])
    back = np.empty(len(keys), np.int64)
    back[at] = np.cumsum(new) - 1
    return both[new], back


def _pairs(table: pa.Table, parts: int):
    """Of a block: its distinct known words (dealt numbers), its distinct pairs as
    places of word and context among them (their number: an unknown one), and of
    each token its pair."""
    steps, word = _held(table)
    ids = np.cumsum(steps)
    known = np.flatnonzero(ids)
    dealt = _dealt(ids[known], parts)
    order = np.argsort(dealt)
    place = np.full(len(ids), len(known))
    place[known[order]] = np.arange(len(known))
    word, ends = place[word], np.cumsum(table.column("n_tokens").to_numpy())
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[np.append(0, ends[:-1])] = word[ends - 1]
    key, pair = _distinct(word * (len(known) + 1) + context, (len(known) + 1) ** 2)
    return dealt[order], key // (len(known) + 1), key % (len(known) + 1), pair


def _entries(dealt: np.ndarray, word: np.ndarray, *values: np.ndarray):
    """Per part: its words, the number of entries of each, and the entries'
    values; entries are sorted by word."""
    n = np.bincount(word, minlength=len(dealt))
    at = np.append(0, np.cumsum(n))
    for p, a, b in _cuts(dealt):
        yield p, _dump(_place(dealt[a:b]), n[a:b], *[v[at[a]:at[b]] for v in values])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    y = x + 8
    return ((y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3)
            + 1 / (1260 * y ** 5) - np.log(product))


def seat(rng, customers: np.ndarray, base, step, others: np.ndarray, strength: float, discount: float):
    """Seat the customers of each dish one by one: tables, and the log of the
    weight that corrects for doing so in turn.

    ``base``: the parent's probability of the dish; it rises by ``step`` with
    each table.  ``others``: tables of other dishes in the restaurant.  Until
    one opens a table the odds of joining only rise by the customers seated, as in
    an urn; so how many join is geometric with a Beta rate.  Beyond ``ONE_BY_ONE``
    customers a step of the loop goes to the next table, not the next customer.
    """
    order = np.argsort(-customers, kind="stable")
    customers, falling = customers[order], -customers[order]
    base, step, others = (np.broadcast_to(x, order.shape)[order] for x in (base, step, others))
    tables, weight, room = np.ones(len(order)), np.zeros(len(order)), strength + discount * others
    for n in range(1, ONE_BY_ONE):
        k = np.searchsorted(falling, -n)  # dishes with customers still to come
        t = tables[:k]
        opens = (room[:k] + discount * t) * (base[:k] + step[:k] * t)
        total = opens + n - discount * t
        weight[:k] += np.log(total)
        t += rng.random(k) * total < opens
    k = np.searchsorted(falling, -ONE_BY_ONE)
    if k:
        _seat_on(rng, customers[:k], base[:k], step[:k], room[:k], discount, tables[:k], weight[:k])
    out, log = np.empty(len(order), np.int64), np.empty(len(order))
    out[order], log[order] = tables, weight
    return out, log


def _weigh(weight: np.ndarray, steps: list) -> None:
    """Add to ``weight`` what steps of (dishes, rates, customers seated) bring."""
    dishes, rate, more = (np.concatenate(x) for x in zip(*steps))
    np.add.at(weight, dishes, _log_gamma(rate + more) - _log_gamma(rate))
    steps.clear()


def _seat_on(rng, customers, base, step, room, discount: float, tables: np.ndarray, weight: np.ndarray) -> None:
    """Seat the customers beyond ``ONE_BY_ONE``, table by table; ``tables`` and
    ``weight`` follow."""
    dishes, t, customers = np.arange(len(customers)), tables.copy(), customers.astype(float)
    seated, steps, held = np.full(len(customers), float(ONE_BY_ONE)), [], 0
    going = customers > seated
    with np.errstate(divide="ignore", over="ignore"):
        while True:
            if not going.all():
                tables[dishes] = t
                dishes, t, customers, seated, base, step, room = (
                    x[going] for x in (dishes, t, customers, seated, base, step, room))
            if len(dishes) <= FEW:
                break
            open_ = discount * t
            opens = (room + open_) * (base + step * t)
            joins = seated - open_
            left = customers - seated
            wait = np.log(rng.random(len(t))) / np.log1p(-rng.beta(opens, joins))
            # customers seated by now: those that join, and one that opens a table
            more = np.minimum(np.floor(wait), left)
            new = more < left
            more += new
            steps.append((dishes, joins + opens, more))
            t, seated = t + new, seated + more
            going = seated < customers
            held += len(dishes)
            if held > 1 << 16:
                _weigh(weight, steps)
                held = 0
    few = [list(x) for x in zip(*(x.tolist() for x in (dishes, t, customers, seated, base, step, room)))]
    random, beta, some = rng.random, rng.beta, ([], [], [])
    while few:
        for dish, u in zip(few, [random() for _ in few]):
            i, t, n, at, b, s, r = dish
            opens = (r + discount * t) * (b + s * t)
            joins = at - discount * t
            left, rate = n - at, beta(opens, joins)
            rate = math.log1p(-rate) if rate < 1 else -math.inf
            wait = math.log(u) / rate if u and rate else math.inf
            new = wait < left and math.floor(wait) < left
            more = math.floor(wait) + 1.0 if new else left
            some[0].append(i)
            some[1].append(joins + opens)
            some[2].append(more)
            dish[1], dish[3] = t + new, at + more
            if at + more >= n:
                tables[i] = t + new
        few = [x for x in few if x[3] < x[2]]
        if len(some[0]) > 1 << 16:
            _weigh(weight, steps + [tuple(map(np.array, some))])
            steps, some = [], ([], [], [])
    if some[0]:
        steps.append(tuple(map(np.array, some)))
    if steps:
        _weigh(weight, steps)


def settle(rng, customers, base, step, others, strength, discount) -> np.ndarray:
    """Tables of each dish: of ``DRAWS`` seatings one, chosen by Metropolis
    steps between them."""
    tables, weight = seat(rng, customers, base, step, others, strength, discount)
    # the rule is exact for two customers
    many = np.flatnonzero(customers > 2)
    base, step = (np.broadcast_to(x, len(customers))[many] for x in (base, step))
    for _ in range(DRAWS - 1):
        new, other = seat(rng, customers[many], base, step, others[many], strength, discount)
        take = np.log(rng.random(len(new))) < other - weight[many]
        tables[many[take]], weight[many[take]] = new[take], other[take]
    return tables


def predictive(model: dict, parent: list, word: np.ndarray, room: np.ndarray, tables: list,
               customers: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Averaged probability of each (word, context).  Of words, per sample:
    ``parent``, (customers, tables) in the parent.  Of pairs: ``word``, its place
    there; the context's customers, ``room``, and per sample its ``tables``;
    ``customers`` of the pair, and ``own``, its tables summed over samples."""
    d, d0, samples = model["discount"], model["top_discount"], model["samples"]
    out = len(samples) * customers - d * own
    for (m, top), t, s in zip(parent, tables, samples):
        p = m - d0 * top + (STRENGTH + d0 * s["top_tables"]) / (model["types"] + 1)
        out = out + (STRENGTH + d * t) * (p / (STRENGTH + s["top_customers"]))[word]
    return out / (STRENGTH + room) / len(samples)


class Part:
    """The dishes of one part: words, and their customers and tables in each
    context; ``seats`` are samples of (tables by pair, tables in the parent).
    ``ids`` are the dealt numbers of the contexts, if they are not numbered as
    they stand."""

    def __init__(self, words, ends, context, customers, tables, top, seats, ids):
        self.words, self.ends, self.context, self.customers = words, ends, context, customers
        self.tables, self.top, self.seats, self.ids = tables, top, seats, ids

    @staticmethod
    def gathered(got: list[tuple], contexts: int) -> Part:
        words, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        each = np.repeat(back, np.concatenate([g[1] for g in got]).astype(np.int64))
        key, back = _distinct(each * contexts + np.concatenate([g[2] for g in got]), len(words) * contexts)
        n = np.bincount(back, np.concatenate([g[3] for g in got])).astype(np.int64)
        ends = np.append(0, np.cumsum(np.bincount(key // contexts, minlength=len(words))))
        return Part(words, ends, key % contexts, n, np.ones(len(key), np.int64), np.ones(len(words), np.int64), [],
                    np.zeros(0, np.int64))

    def numbered(self, parts: int) -> Part:
        """With contexts numbered, and pairs of a word sorted, by dealt number."""
        self.ids, context = np.unique(_dealt(self.context, parts), return_inverse=True)
        order = np.lexsort((context, self.word_of()))
        self.context, self.customers, self.tables = context[order], self.customers[order], self.tables[order]
        return self

    def dump(self) -> bytes:
        seats = [x for s in self.seats for x in s]
        return pickle.dumps((self.words.dtype.str, _dump(
            self.words, np.diff(self.ends), self.context, self.customers, self.tables, self.top,
            _steps(self.ids), *seats)))

    @staticmethod
    def load(payload: bytes) -> Part:
        kind, arrays = pickle.loads(payload)
        words, n, context, customers, tables, top, ids, *seats = _load(arrays)
        return Part(words.astype(kind), np.append(0, np.cumsum(n)), context, customers, tables, top,
                    list(zip(seats[::2], seats[1::2])), np.cumsum(ids))

    def word_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), np.diff(self.ends))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.ends[:-1])

    def sweep(self, rng, model: dict) -> None:
        """Seat all dishes anew, first in the contexts, then in the parent;
        ``model`` follows."""
        d, d0 = model["discount"], model["top_discount"]
        word, tables = self.word_of(), np.array(model["tables"], float)
        top_customers, top_tables = model["top_customers"], model["top_tables"]
        for some in np.array_split(rng.permutation(np.flatnonzero(self.customers > 1)), TURNS):
            if not len(some):
                continue
            w, old = word[some], self.tables[some]
            rest = self.by_word(self.tables)[w] - old
            # the dish's tables in the parent that are left, and the one that its first table here needs
            top = np.maximum(1, np.minimum(self.top[w], rest))
            uniform = (STRENGTH + d0 * (top_tables - self.top[w] + top)) / (model["types"] + 1)
            room = STRENGTH + np.maximum(0, top_customers - old) + 1
            others = np.maximum(0, tables[self.context[some]] - old)
            new = settle(rng, self.customers[some], (rest - d0 * top + uniform) / room, 1 / room, others, STRENGTH, d)
            self.tables[some] = new
            np.add.at(tables, self.context[some], new - old)
            top_customers += (new - old).sum()
        old = self.top.sum()
        served = self.by_word(self.tables)
        self.top[served == 1] = 1
        top_tables += self.top.sum() - old
        for some in np.array_split(rng.permutation(np.flatnonzero(served > 1)), TURNS):
            if not len(some):
                continue
            m, others = served[some], np.maximum(0, top_tables - self.top[some])
            new = settle(rng, m, 1 / (model["types"] + 1), 0.0, others, STRENGTH, d0)
            top_tables += (new - self.top[some]).sum()
            self.top[some] = new
        model |= {"tables": tables, "top_customers": top_customers, "top_tables": top_tables}

    def sums(self, contexts: int) -> np.ndarray:
        """Tables of each context and of the parent, of each sample (or of the
        seating as it is)."""
        return np.concatenate([np.append(np.bincount(self.context, t, contexts), u.sum())
                               for t, u in self.seats or [(self.tables, self.top)]])

    def counter(self, context: np.ndarray, contexts: int):
        """Looks up words and, of each, contexts (numbered as the pairs'
        ``context``, below ``contexts``; below 0: none).  Of words: customers, and
        (customers, tables) in the parent by sample.  Of their pairs: customers, and
        tables summed over samples.  Zeros for what is not here."""
        keys, total = self.word_of() * contexts + context, self.by_word(self.customers)
        top, seats = [(self.by_word(t), u) for t, u in self.seats], sum(t for t, _ in self.seats)

        def counted(words: np.ndarray, per_word: np.ndarray, asked: np.ndarray):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            each = np.repeat(np.arange(len(words)), per_word)
            wanted = at[each] * contexts + asked
            pair = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            seen = known[each] & (keys[pair] == wanted) & (asked >= 0)
            parent = [(np.where(known, m[at], 0), np.where(known, u[at], 0)) for m, u in top]
            return (np.where(known, total[at], 0), parent,
                    np.where(seen, self.customers[pair], 0), np.where(seen, seats[pair], 0))

        return counted

    def probabilities(self, words: np.ndarray, per_word: np.ndarray, context: np.ndarray, model: dict):
        """Averaged predictive probability of each (word, context), and the
        words' training counts."""
        contexts = int(max(self.context.max(), context.max(initial=0))) + 1
        counts, parent, customers, own = self.counter(self.context, contexts)(words, per_word, context)
        each = np.repeat(np.arange(len(words)), per_word)
        return predictive(model, parent, each, model["customers"][context],
                          [s["tables"][context] for s in model["samples"]], customers, own), counts


def _share(one: float, two: float) -> float:
    """Discount by the counts of ones and twos."""
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5


def _told(number: int, part: Part, parts: int, more=()) -> pa.RecordBatch:
    """Rows of a part: itself (part -1) with sums over it, by sample the tables in
    contexts and in the parent; and what it tells each group of parts: the tables
    of their words as contexts (to its own group, its words too).  About
    ``sqrt(parts)`` parts are a group, so the rows do not grow as parts squared."""
    contexts, width = len(part.ids), max(1, round(parts ** 0.5))
    tables = part.sums(contexts).reshape(-1, contexts + 1).astype(np.int64)
    sums = np.append(np.column_stack((tables[:, :-1].sum(axis=1), tables[:, -1])).ravel(), more)
    none, own, home = np.zeros(0, np.int64), _steps(part.words + (number << 40)), number // width
    out = {home: _dump(none, own, *[none] * len(tables))}
    for g, a, b in _cuts((part.ids >> 40) // width << 40):
        out[g] = _dump(_steps(part.ids[a:b]), own if g == home else none, *tables[:, a:b])
    rows = [(-1, part.dump(), sums.tolist()), *[(g, x, None) for g, x in out.items()]]
    return pa.RecordBatch.from_pydict({
        "block": pa.array([number] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int64()),
        "payload": pa.array([r[1] for r in rows], pa.binary()),
        "sums": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})


def _totals(told: list[tuple[int, bytes]]):
    """Of a group's words: dealt numbers, and tables by sample in all parts; and
    which of them each part told of."""
    got = [_load(x) for _, x in told]
    ids = np.sort(np.concatenate([np.cumsum(words) for _, words, *_ in got]))
    tables, places = np.zeros((len(got[0]) - 2, len(ids)), np.int64), []
    for contexts, _, *t in got:
        places.append(np.searchsorted(ids, np.cumsum(contexts)))
        tables[:, places[-1]] += np.array(t)
    return ids, tables, places


def _reply(group, told):
    _, tables, places = _totals(told)
    for (part, _), at in zip(told, places):
        if len(at):
            yield part, _dump(*tables[:, at])


def _spread(group, told):
    """Each part's own words: tables by sample, in all parts."""
    ids, tables, _ = _totals(told)
    for p, a, b in _cuts(ids):
        yield p, _dump(*tables[:, a:b])


def _sums(state: DataFrame) -> np.ndarray:
    rows = state.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def train(encoded: DataFrame, parts: int):
    """Seating of all training tokens: stored parts with what they tell each
    other, and the model's sums."""

    def question(block, table):
        train = np.repeat(table.column("__train").to_numpy(), table.column("n_tokens").to_numpy())
        if train.any():
            words, word, context, pair = _pairs(table, parts)
            customers = np.bincount(pair[train], minlength=len(word))
            here = np.flatnonzero(customers)
            ids = _place(words) * parts + (words >> 40) + 1
            asked, word = np.unique(word[here], return_inverse=True)
            yield from _entries(words[asked], word, ids[context[here]], customers[here])

    def gather(batches):
        for number, rows in B.grouped(B.rows_of(batches), 1):
            got = [_load(x) for _, _, x in rows]
            part = Part.gathered(got, 1 + max(int(g[2].max()) for g in got)).numbered(parts)
            kinds = np.diff(part.ends)
            yield _told(number, part, parts, [
                len(part.words), part.customers.sum(), (part.customers == 1).sum(), (part.customers == 2).sum(),
                (kinds == 1).sum(), (kinds == 2).sum()])

    state = B.stored(B.by_key(B.ask(encoded, question), "part", "block").mapInArrow(gather, STATE), "seats")
    v = _sums(state)
    if not len(v):
        v = np.zeros(8)
    model = {"top_customers": v[0], "top_tables": v[1], "types": v[2], "tokens": v[3],
             "discount": _share(*v[4:6]), "top_discount": _share(*v[6:])}
    for turn in range(ROUNDS):
        def gibbs(batches, turn=turn, model=dict(model)):
            for number, rows in B.grouped(B.rows_of(batches), 0):
                part, rng, here = Part.load(rows[0][2]), np.random.default_rng([SEED, turn, number]), dict(model)
                here["tables"] = np.concatenate([_load(x)[0] for _, _, x in rows[1:]])
                for _ in range(SWEEPS):
                    part.sweep(rng, here)
                    if turn == ROUNDS - 1:
                        part.seats.append((part.tables.copy(), part.top.copy()))
                yield _told(number, part, parts)

        told = B.answer(state.filter("part >= 0").select("block", "part", "payload"), _reply)
        both = state.filter("part < 0").select("block", "part", "payload").unionByName(told)
        before, state = state, B.stored(B.by_key(both, "block", "part").mapInArrow(gibbs, STATE), "seats")
        B.dropped(before)
        samples = [{"top_customers": x[0], "top_tables": x[1]} for x in _sums(state).reshape(-1, 2)]
        model |= samples[-1] if samples else {}
    return state, model | {"samples": samples or [{"top_customers": 0.0, "top_tables": 0.0}]}


def score_texts(docs: DataFrame, train_when, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``__train``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 probabilities) of every row; the rows for
    which ``train_when`` is true train the model.

    Tokens are words of A-Z lower-cased text between white space, then one end.
    Null and empty texts are their end alone.  Repeated rows train and are scored
    each time they stand; with no training rows (train_tokens 0) every token has
    the unknown's probability, 1.  An empty table gives an empty result; other
    columns are left out.
    """
    parts = B.part_count(docs.sparkSession)
    packed = B.pack(docs.select(id_col, F.coalesce(train_when, F.lit(False)).alias("__train"), text_col),
                    dump=lambda batches: tokenised(batches, id_col, text_col))
    encoded = encode(packed, parts, id_col)
    B.dropped(packed)
    state, model = train(encoded, parts)
    samples = len(model["samples"])

    def question(block, table):
        words, word, context, _ = _pairs(table, parts)
        known = word < len(words)
        ids = np.append(_place(words) * parts + (words >> 40) + 1, 0)
        yield from _entries(words, word[known], ids[context[known]])

    def reply(number, rows):
        part, tables = Part.load(rows[0][1]), np.array(_load(rows[1][1]))
        most = int(_place(part.ids).max()) + 1
        counted = part.counter(((part.ids >> 40) * most + _place(part.ids))[part.context], parts * most)
        for block, x in rows[2:]:
            words, n, ids = _load(x)
            owner, place = (ids - 1) % parts, (ids - 1) // parts
            context = np.where((ids > 0) & (place < most), owner * most + place, -1)
            counts, parent, customers, own = counted(words, n, context)
            yield block, _dump(counts, *[v for p in parent for v in p], *tables[:, words], customers, own)

    def score(block, table, got):
        words, word, context, pair = _pairs(table, parts)
        told = [_load(got[p]) for p in sorted(got)]
        known = word < len(words)
        # the last word is the unknown one, no customer anywhere
        of_word = [np.append(np.concatenate([t[i] for t in told] or [[]]), 0.0) for i in range(1 + 3 * samples)]
        customers, own = np.zeros(len(word)), np.zeros(len(word))
        if told:
            customers[known], own[known] = (np.concatenate([t[i] for t in told]) for i in (-2, -1))
        parent = [of_word[1 + 2 * s:3 + 2 * s] for s in range(samples)]
        tables = [of_word[1 + 2 * samples + s][context] for s in range(samples)]
        log = np.log10(predictive(model, parent, word, of_word[0][context], tables, customers, own))
        n_tokens = table.column("n_tokens").to_numpy()
        doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
        base = table.column("base").to_numpy() - n_tokens * np.log10(model["tokens"] + 0.5 * (model["types"] + 1))
        yield from pa.table({
            id_col: table.column(id_col), "__train": table.column("__train"),
            "n_tokens": table.column("n_tokens"), "n_known": table.column("n_known"),
            "train_tokens": pa.array(np.full(len(base), int(model["tokens"]), np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(np.bincount(doc, log[pair], len(base)))}).combine_chunks().to_batches()

    # to a part come itself, its words' tables, then questions
    kept = state.filter("part < 0").select(F.lit(-2).cast("long").alias("block"), F.col("block").alias("part"), "payload")
    tables = B.answer(state.filter("part >= 0").select("block", "part", "payload"), _spread).select(
        F.lit(-1).cast("long").alias("block"), F.col("block").alias("part"), "payload")
    asked = B.ask(encoded, question).unionByName(kept).unionByName(tables)
    kind = docs.schema[id_col].dataType.simpleString()
    return B.apply(encoded, B.answer(asked, reply), score,
                   f"{id_col} {kind}, __train boolean, n_tokens long, n_known long, train_tokens long, "
                   "base_score double, score double")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    return score_texts(docs, ~held).select(
        "doc_id", (~F.col("__train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
