"""Language identification of mixed texts.

A word's score in a language is the sum over its bytes of the log probability of
the byte with its two neighbours, learned from all training texts.  The script
of a word, told from the code range of its first letter, narrows the languages
that may claim it to those that learned words of that script.  Words are runs of
letters and their marks: spaces, digits and punctuation of every script part them.  Viterbi then
labels the words of a text: it adds up word scores and pays ``SWITCH`` for each
change of language, so single odd words don't break a span.

Viterbi runs over blocks of words at once: a block's best score from each state
before it to each state at its end is found for all blocks together, the blocks
of a text are chained, and the paths are read back within all blocks together.
With many languages, where a table of pairs of states would be large, it runs
along all texts together instead, word by word.
"""

from __future__ import annotations

import pickle
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B

#: Features at most, and entries of the model at most: with more languages it
#: has fewer features, never fewer languages.
FEATURES, ENTRIES = 1 << 16, 1 << 24
PARTS = 16
#: Languages up to which Viterbi runs over blocks of words.
FEW = 32
SWITCH = 12.0
BLOCK = 32
#: A language learns a script that makes up this share of its words.
SCRIPT_SHARE = 0.01
IMPOSSIBLE = -1e9

# Scripts by the range of a letter's first UTF-8 byte.
SCRIPTS = [
    ("latin", 0x61, 0x7A), ("latin", 0xC2, 0xCB), ("combining", 0xCC, 0xCD), ("greek", 0xCE, 0xCF),
    ("cyrillic", 0xD0, 0xD3), ("armenian-hebrew", 0xD4, 0xD7), ("arabic", 0xD8, 0xDB), ("other", 0xDC, 0xDF),
    ("indic", 0xE0, 0xE0), ("south-east-asian", 0xE1, 0xE1), ("symbols", 0xE2, 0xE2), ("kana-cjk", 0xE3, 0xE3),
    ("cjk", 0xE4, 0xE9), ("hangul", 0xEA, 0xED), ("other", 0xEE, 0xF7),
]
NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["unlisted"]
SCRIPT_OF = np.full(256, NAMES.index("unlisted"))
for _name, _low, _high in SCRIPTS:
    SCRIPT_OF[_low:_high + 1] = NAMES.index(_name)
#: Letters of ASCII in lower case and bytes of other characters; the rest are spaces.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Letters(dict):
    """Code point -> itself for letters and marks, a space for all else."""

    def __missing__(self, c: int) -> int:
        kept = self[c] = c if unicodedata.category(chr(c))[0] in "LM" else 32
        return kept


_LETTERS = _Letters()


def _letters(text: str) -> bytes:
    low = text.lower()
    return (low if low.isascii() else low.translate(_LETTERS)).encode().translate(LETTERS)


def _words(texts: list[str | None], features: int = FEATURES):
    """Of all texts: feature of each word byte, start of each word among them,
    script of each word, and how many words each text has."""
    parts = [b" " + _letters(t) + b" " if t else b"  " for t in texts]
    a = np.frombuffer(b"".join(parts), np.uint8)
    inside = a != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    at = np.flatnonzero(inside)
    code = (a[at - 1].astype(np.uint32) << 16) | (a[at].astype(np.uint32) << 8) | a[at + 1]
    feature = (code * np.uint32(2654435761)) >> np.uint32(33 - features.bit_length())
    ends = np.cumsum([len(p) for p in parts])
    before = np.searchsorted(starts, ends)
    return feature, np.searchsorted(at, starts), SCRIPT_OF[a[starts]], np.diff(np.append(0, before))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """Log probabilities (feature, language) and the scripts each learned."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages, self.features = languages, len(counts)
        smooth = counts + 0.5
        self.score = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.claims = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
        self.claims[~self.claims.any(axis=1)] = True

    def words(self, texts: list[str | None]):
        feature, start, script, n = _words(texts, self.features)
        sums = np.add.reduceat(self.score[feature], start, axis=0).astype(float) if len(start) else np.zeros(
            (0, len(self.languages)))
        sums[~self.claims[script]] = IMPOSSIBLE
        return sums, np.diff(np.append(start, len(feature))), n


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """Best label of each word: texts lie one after the other, ``counts`` words
    each.  Ties keep the state, then take the smaller label."""
    k = scores.shape[1]
    if not len(scores):
        return np.zeros(0, np.int64)
    if k > FEW:
        return _along(scores, counts, switch)
    blocks = -(-counts // block)
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first * block, counts)
    padded = np.zeros((int(blocks.sum()) * block, k))
    padded[place] = scores
    padded = padded.reshape(-1, block, k)
    # best[b, s, l]: from state s before block b to state l
    best = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -switch), (len(padded), k, k)) + padded[:, 0, None, :]
    back = np.empty((block, len(padded), k, k), np.uint8)
    labels = np.arange(k, dtype=np.uint8)
    for t in range(1, block):
        top = best.argmax(axis=2)
        change = np.take_along_axis(best, top[:, :, None], 2) - switch
        stay = best >= change
        back[t] = np.where(stay, labels, top[:, :, None])
        best = np.where(stay, best, change) + padded[:, t, None, :]
    order = np.argsort(-blocks, kind="stable")
    deep = -blocks[order]
    state = np.zeros((len(order), k))
    enter = np.empty((len(padded), k), np.int64)
    for i in range(int(blocks.max())):
        n = np.searchsorted(deep, -i)
        here = first[order[:n]] + i
        paths = state[:n, :, None] + best[here]
        enter[here] = paths.argmax(axis=1)
        state[:n] = paths.max(axis=1)
    end = state.argmax(axis=1)
    last, start = np.empty(len(padded), np.int64), np.empty(len(padded), np.int64)
    for i in range(int(blocks.max()) - 1, -1, -1):
        n = np.searchsorted(deep, -i)
        here = first[order[:n]] + i
        last[here] = end[:n]
        start[here] = end[:n] = enter[here, end[:n]]
    out, row = np.empty((len(padded), block), np.int64), np.arange(len(padded))
    now = last
    for t in range(block - 1, -1, -1):
        out[:, t] = now
        if t:
            now = back[t][row, start, now].astype(np.int64)
    return out.reshape(-1)[place]


def _along(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """``viterbi`` word by word, the longest texts first so that those with a
    word left are a prefix."""
    k = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    n, start = counts[order], (np.cumsum(counts) - counts)[order]
    best = np.zeros((len(n), k))
    back = np.empty((len(scores), k), np.uint16)
    labels = np.arange(k, dtype=np.uint16)
    for t in range(int(n[0])):
        live = int(np.searchsorted(-n, -t, side="left"))
        here = start[:live] + t
        if t:
            top = best[:live].argmax(axis=1)
            change = best[np.arange(live), top][:, None] - switch
            stay = best[:live] >= change
            back[here] = np.where(stay, labels, top[:, None])
            best[:live] = np.where(stay, best[:live], change)
        best[:live] += scores[here]
    out, now = np.empty(len(scores), np.int64), best.argmax(axis=1)
    for t in range(int(n[0]) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        here = start[:live] + t
        out[here] = now[:live]
        if t:
            now[:live] = back[here, now[:live]]
    return out


def feature_count(languages: int) -> int:
    """Features of a model: a power of two, fewer where languages are many."""
    return max(256, min(FEATURES, 1 << (ENTRIES // max(1, languages)).bit_length() - 1))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a text and a language, of any number of
    languages.  A task adds up its own rows; what it sends on, and the model, have
    ``ENTRIES`` entries at most (256 a language from 65,536 languages on)."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    number, features = {x: i for i, x in enumerate(languages)}, feature_count(len(languages))
    size = features // PARTS

    def count(batches):
        counts, scripts = np.zeros((len(languages), features), np.int64), np.zeros((len(languages), len(NAMES)), np.int64)
        for batch in batches:
            for b in B.slices(batch, B.TARGET):
                texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    feature, _, script, _ = _words([t for t, x in zip(texts, langs) if x == lang], features)
                    counts[number[lang]] += np.bincount(feature, minlength=features)
                    scripts[number[lang]] += np.bincount(script, minlength=len(NAMES))
        if scripts.any():
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(PARTS + 1), pa.int64()),
                "payload": pa.array([pickle.dumps(B.small(counts[:, p * size:(p + 1) * size].reshape(-1)))
                                     for p in range(PARTS)] + [pickle.dumps(scripts.reshape(-1))], pa.binary())})

    def add(batches):
        for part, rows in B.grouped(B.rows_of(batches), 0):
            total = sum(pickle.loads(x).astype(np.int64) for _, x in rows)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()),
                                              "payload": pa.array([pickle.dumps(total)], pa.binary())})

    both = "part long, payload binary"
    got = dict(B.by_key(rows.mapInArrow(count, both), "part").mapInArrow(add, both).collect())
    k = len(languages)
    if not got:
        return Model(languages, np.zeros((features, k), np.int64), np.zeros((len(NAMES), k), np.int64))
    counts = np.concatenate([pickle.loads(bytes(got[p])).reshape(k, -1) for p in range(PARTS)], axis=1)
    return Model(languages, counts.T, pickle.loads(bytes(got[PARTS])).reshape(k, -1).T)


def language_spans(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``.

    ``spans`` are runs of words of one language: lang, start and end (exclusive,
    in words of letters).  ``lang_pred`` is the language whose spans hold most
    letter bytes (the smaller name if several do), ``score`` their share.

    A text that is null or has no letter is ``und`` with score 0 and no span; so
    is every text if nothing was learned.  Repeated rows are labelled alike; an
    empty table gives an empty result; input columns with the new names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = max(1, len(model.languages))
    # a word's row in the tables of Viterbi: k entries, k * k a block with few languages
    target = max(1 << 14, B.TARGET // 2 * 16 // max(16, k * k if k <= FEW else 8 * k))
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        m = sent.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for b in B.slices(batch, target):
                texts = [t if m.languages and has_letter(t) else None for t in b.column(text_col).to_pylist()]
                scores, length, n = m.words(texts) if m.languages else (np.zeros((0, 1)), np.zeros(0, np.int64),
                                                                       np.zeros(len(texts), np.int64))
                label = viterbi(scores, n, switch)
                doc = np.repeat(np.arange(len(n)), n)
                held = np.zeros((len(n), k))
                np.add.at(held, (doc, label), length)
                best, total = held.argmax(axis=1), held.sum(axis=1)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                before = (np.cumsum(n) - n)[doc[at]]
                end = np.append(at[1:], len(label))[:len(at)] - before
                spans = pa.StructArray.from_arrays(
                    [pa.array(names[label[at]], pa.string()), pa.array(at - before, pa.int32()), pa.array(end, pa.int32())],
                    fields=list(span))
                ends = np.append(0, np.cumsum(np.bincount(doc[at], minlength=len(n))))
                yield from B.add_columns(pa.Table.from_batches([b]), {
                    "lang_pred": pa.array(np.where(total > 0, names[best], "und"), pa.string()),
                    "score": pa.array(np.where(total > 0, held.max(axis=1) / np.maximum(1, total), 0.0)),
                    "spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)})

    return docs.mapInArrow(run, B.with_columns(
        docs.schema, "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"))


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = learn(docs.filter(~held))
    return language_spans(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "spans")
