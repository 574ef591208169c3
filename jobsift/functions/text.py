"""String helpers as JVM-side Column expressions.

Java regex differs from Python's: ``\\w`` is ASCII unless ``(?U)`` is given,
``trim`` strips only spaces, ``initcap`` capitalises every word.  These
helpers pin down the Python meaning.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern of the TF-IDF tokenizer (runs of >= 2 word
# characters, Unicode aware) and the HTML clean-up patterns.
TOKEN_PATTERN = r"(?U)\w\w+"
#: character references that most pages hold
COMMON = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "mdash", "ndash", "laquo", "raquo")
_WS = r"(?U)^\s+|\s+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions referenced several times inside higher-order functions are
    otherwise re-embedded (and re-evaluated) at every reference; binding them
    keeps the expression tree linear in size."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), _WS, "")


def squeeze(c) -> Column:
    """Collapse whitespace runs to one space."""
    return F.regexp_replace(_c(c), r"(?U)\s+", " ")


def capitalize(c) -> Column:
    """Python ``str.capitalize()``: first letter upper, the rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def tokens(c) -> Column:
    """Lower-cased word tokens of length >= 2 (the TF-IDF tokenizer)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def html_to_text(c) -> Column:
    """Visible text of an HTML page.

    Script and style bodies and comments go first (scripts may hold tag-like
    strings), then tags, then character references; whitespace is squeezed.
    """
    c = _c(c)
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>", " ")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return strip(squeeze(unescape(c)))


def unescape(c) -> Column:
    """HTML character references decoded once: all names of the standard
    library's table (``&name;``), decimal and hexadecimal numbers; unknown names
    and bare ampersands stay, impossible numbers become U+FFFD.

    The names that pages mostly hold are compared first; the table's other names
    lie in maps by their first letter, as a map is searched from its start."""
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    by_letter: dict[str, dict[str, str]] = {}
    for k, v in names.items():
        by_letter.setdefault(k[0], {})[k] = v
    tables = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")
    pattern = r"&(?:#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[A-Za-z][A-Za-z0-9]*);"

    def char(code):
        ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        safe = F.when(ok, code).otherwise(0xFFFD)
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    def one(ref):
        body = F.substring(ref, 2, F.length(ref) - 2)
        return (F.when(body.rlike("^#[xX]"), char(F.conv(F.substring(body, 3, 8), 16, 10).try_cast("long")))
                .when(body.startswith("#"), char(F.substring(body, 2, 9).try_cast("long")))
                .otherwise(F.coalesce(F.try_element_at(F.try_element_at(tables, F.substring(body, 1, 1)), body), ref)))

    def named(ref):
        out = one(ref)
        for name in reversed(COMMON):
            out = F.when(ref == f"&{name};", F.lit(names[name])).otherwise(out)
        return out

    def put_together(parts):
        return F.concat(F.array_join(F.zip_with(
            F.slice(parts["rest"], 1, F.size(parts["refs"])), parts["refs"], lambda t, r: F.concat(t, named(r))), ""),
            F.element_at(parts["rest"], -1))

    c = _c(c)
    parts = F.struct(F.regexp_extract_all(c, F.lit(pattern), 0).alias("refs"), F.split(c, pattern, -1).alias("rest"))
    return F.when(c.contains("&"), let(parts, put_together)).otherwise(c)


def strip_prefix_id(c, prefix: str = "v_") -> Column:
    """Remove a literal id prefix."""
    return F.regexp_replace(_c(c), "^" + prefix, "")


def after_underscore(c) -> Column:
    """P15 variant: the part after the first ``_`` (null when absent)."""
    return F.try_element_at(F.split(_c(c), "_", 2), F.lit(2))
