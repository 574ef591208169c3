"""Awkward rows that every operator must take, and words as the contracts cut them."""

import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, kept_text string, "
          "ids string, block int, payload string, row string, part double, score string, __fp string, spans string")
LONG = " ".join(f"w{i % 97} x{i % 89}" for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (2, None, "en"), (3, "", None), (4, " \t\n ", "en"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (6, "one", "en"), (7, "one two", "en"), (8, LONG, "en"), (9, "x " + PASSAGE + " tail words", "en"),
    (10, PASSAGE, "en"), (11, "Lead in " + PASSAGE.upper() + "\nLICENSED under CC BY-NC 4.0.", "en"),
    (12, "alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta\nline\nline\n\nline", "en"),
    (13, "Größe straße über ÄÖÜ ▁   日本語 \U0001F600 naïve\x00nul", "de"),
    (14, "All rights reserved. all-rights/reserved GNU General Public License", "en"),
    (15, PASSAGE + " " + PASSAGE, "en"), (None, PASSAGE + " extra", None), (None, "one", "de"),
    (16, "a" * 3000, "en"), (6, "one", "en"), (6, "another text with the same id", "en"),
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, lang, "s", None if t is None else len(t)) + (None,) * 10 for i, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def by_rows(rows):
    return sorted(map(repr, rows))
