"""Resume and list-text parsing (I1, I2, I12-I14, I17) as Column expressions.

Resume text is read word by word: headers, durations and periods are told
from word tables at a word's place, not from one pattern over the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsift.functions.text import capitalize, let, strip

# Russian duration words, the experience header, month names and
# the "until now" wording of resume periods.
YEAR_WORDS = ["год", "года", "лет"]
MONTH_WORDS = ["месяц", "месяца", "месяцев"]
HEADER = ["Опыт", "работы"]
MONTHS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август",
          "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"]
NOW = [["по", "настоящее", "время"], ["настоящее", "время"]]
#: a duration word stands at most so many words after the header
HEADER_REACH = 7


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_quoted_list(c) -> Column:
    """Items of a Python list literal of quoted strings, e.g. "['a', 'b']"."""
    return F.regexp_extract_all(_c(c), F.lit(r"'([^']*)'"), 1)


def parse_int_list(c) -> Column:
    """A literal list of integers, e.g. "[1, 2, 3]"."""
    return F.from_json(_c(c), "array<int>")


def normalise_skill_list(c) -> Column:
    """I2 (Q10 fixed): "[a, 'b', ]" -> ['A', 'B']: brackets stripped, split on
    commas, whitespace and quotes stripped, first letter capitalised, blank
    items dropped; a list without items is null."""
    body = F.regexp_replace(_c(c), r"^[\[\]]+|[\[\]]+$", "")
    items = F.transform(F.split(body, ","), lambda s: capitalize(F.regexp_replace(strip(s), "^'+|'+$", "")))
    kept = F.filter(items, lambda s: F.length(s) > 0)
    return F.when(F.size(kept) > 0, kept)


def split_answer(c, n: int = 3) -> list[Column]:
    """I17: 'region;title;years' -> three columns (missing parts are null)."""
    parts = F.split(_c(c), ";")
    return [F.try_element_at(parts, F.lit(i + 1)) for i in range(n)]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def _one_of(word: Column, table: list[str]) -> Column:
    return word.isin(*table)


def _places(words: Column, test) -> Column:
    """1-based places at which ``test(place)`` holds (null counts as false)."""
    every = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.coalesce(test(i), F.lit(False)))


def _at(words: Column, i: Column) -> Column:
    return F.get(words, i - 1)


def drop_durations(c) -> Column:
    """Remove every number followed by a duration word, strip the rest."""
    unit = "|".join(sorted(YEAR_WORDS + MONTH_WORDS, key=len, reverse=True))
    return strip(F.regexp_replace(_c(c), rf"(?U)(?<!\w)\d+\s+({unit})(?!\w)", ""))


def experience_block(c) -> Column:
    """I13 part 1: the words from one experience header to the next.  A header
    is the words of ``HEADER`` with a duration word at most ``HEADER_REACH``
    words on.  The second block counts when the header is repeated, else the
    first; null without a header."""
    units = YEAR_WORDS + MONTH_WORDS

    def cut(words):
        def is_header(i):
            near = F.slice(words, i + 2, HEADER_REACH)
            return ((_at(words, i) == HEADER[0]) & (_at(words, i + 1) == HEADER[1])
                    & F.exists(near, lambda w: _one_of(w, units)))

        def take(heads):
            pick = F.least(F.size(heads), F.lit(2))
            start = F.get(heads, pick - 1)
            end = F.coalesce(F.get(heads, pick), F.size(words) + 1)
            return F.when(F.size(heads) > 0, F.array_join(F.slice(words, start, end - start), " "))

        return let(_places(words, is_header), take)

    return F.when(_c(c).isNotNull(), let(_words(_c(c)), cut))


def experience_months(c) -> Column:
    """I13 part 2: total months of the numbers before year and month words.
    The header's words are passed over; any other word, or a duration word
    without a number before it, makes the result null."""
    def total(words):
        def months(i):
            word, number = _at(words, i), F.when(i > 1, _at(words, i - 1)).try_cast("long")
            return (F.when(_one_of(word, YEAR_WORDS), number * 12).when(_one_of(word, MONTH_WORDS), number)
                    .when(word.rlike(r"^\d+$"), F.lit(0).cast("long")))

        each = F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words)), months)).otherwise(
            F.array().cast("array<long>"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    words = F.filter(_words(_c(c)), lambda w: ~_one_of(w, HEADER))
    return F.when(_c(c).isNotNull(), let(words, total))


def split_jobs(c) -> Column:
    """The texts of the jobs in a resume: what stands after each period
    ("Month YYYY — Month YYYY", or "— until now") up to the next, without
    duration phrases; blank ones are dropped.  Null without a period."""
    def jobs(words):
        year = lambda i: _at(words, i).rlike(r"^\d{4}$")

        def length(i):
            """Words of the period that begins at place i; null if none does."""
            begins = _one_of(_at(words, i), MONTHS) & year(i + 1) & _one_of(_at(words, i + 2), ["—", "-"])
            out = F.when(begins & _one_of(_at(words, i + 3), MONTHS) & year(i + 4), F.lit(5))
            for now in NOW:
                same = F.slice(words, i + 3, len(now)) == F.array(*[F.lit(w) for w in now])
                out = out.when(begins & same, F.lit(3 + len(now)))
            return out

        def texts(starts):
            def after(place, n):
                start = place + length(place)
                end = F.coalesce(F.get(starts, n + 1), F.size(words) + 1)
                return drop_durations(F.array_join(F.slice(words, start, end - start), " "))

            return F.when(F.size(starts) > 0, F.filter(F.transform(starts, after), lambda t: F.length(t) > 0))

        return let(_places(words, lambda i: length(i).isNotNull()), texts)

    # a dash may touch the year before it or the word after it
    spaced = F.regexp_replace(_c(c), r"(?U)(?<=\d{4})\s*([—-])\s*", " $1 ")
    return F.when(_c(c).isNotNull(), let(_words(spaced), jobs))
