"""String column functions: whitespace repair, null tokens, tolerant numbers,
HTML escaping, latin-1 folding and token estimates.

All are Column -> Column and stay JVM-side; ``fold_text`` applies a table of
code points that the driver builds once by rule.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .cache import column_cache

# Whitespace is Unicode White_Space (NBSP, EM SPACE, NEL ...); a plain \s
# regex and Spark's trim() only see ASCII.
# Plain decimal text; rejects Java suffixes such as "12d" that try_cast accepts.
DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_TEXT = r"^[+-]?\d+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@column_cache
def trim_ws(col) -> Column:
    """Strip leading/trailing Unicode whitespace (character-set trim, no
    regex)."""
    return F.btrim(_c(col), F.lit(C.WHITESPACE))


def null_tokens(col, tokens=C.NULL_TOKENS) -> Column:
    """Case-sensitive null tokens -> null."""
    c = _c(col)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


@column_cache
def strip_inner_ws(col) -> Column:
    """Remove every whitespace character, inner ones included (character
    deletion with translate, no regex)."""
    return F.translate(_c(col), C.WHITESPACE, "")


@column_cache
def to_number(col, dtype: str = "double") -> Column:
    """Whitespace-free tolerant cast: text that is not a plain number -> null."""
    s = strip_inner_ws(col)
    pattern = INTEGER_TEXT if dtype in ("bigint", "long", "int") else DECIMAL_TEXT
    return F.when(s.rlike(pattern), s.try_cast(dtype))


@column_cache
def html_escape(col) -> Column:
    """Escape the five HTML specials, ampersand first."""
    c = _c(col)
    for raw, esc in C.HTML_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


@column_cache
def estimate_tokens(col) -> Column:
    """~4 characters per token, rounded down."""
    return F.floor(F.char_length(_c(col)) / F.lit(C.CHARS_PER_TOKEN)).cast("bigint")


def _ascii_escape(c: Column) -> Column:
    """\\uXXXX of one character outside ASCII (a surrogate pair beyond the
    basic plane)."""
    code = F.ascii(c)
    unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
    high, low = F.shiftright(code - 65536, 10) + 55296, (code - 65536) % 1024 + 56320
    return F.when(code < 65536, unit(code)).otherwise(F.concat(unit(high), unit(low)))


@column_cache
def json_text(col) -> Column:
    """A text as an ASCII JSON string, null as ``null``."""
    q = F.to_json(F.array(_c(col).cast("string")))
    q = F.substr(q, F.lit(2), F.length(q) - 2)
    escaped = F.array_join(F.transform(F.split(q, ""), lambda x: F.when(
        F.octet_length(x) <= 1, x).otherwise(_ascii_escape(x))), "")
    return F.when(_c(col).isNull(), F.lit("null")).when(
        F.octet_length(q) == F.length(q), q).otherwise(escaped)


@column_cache
def number_text(col) -> Column:
    """A double in the shortest form that reads back as itself: plain between
    1e-4 and 1e16, else with an exponent of two digits or more.  Numbers below
    the normal range (2.3e-308) may show more digits than they need, and of two
    equally short forms it may be the other one (both read back as the number)."""
    x = _c(col).cast("double")
    forms = [F.format_string(f"%.{p}e", x) for p in (14, 15, 16)]
    form = F.when(x.isNotNull(), F.coalesce(*[F.when(f.try_cast("double") == x, f) for f in forms[:-1]], forms[-1]))
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    # a lambda's argument is computed once, however often it is used
    return F.coalesce(special, F.element_at(F.transform(F.transform(F.array(form), _number_parts), _number_from_parts), 1))


def _number_parts(form: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(form, "e", 1), "[-.]", ""), "(?<=.)0+$", "")
    return F.struct(F.when(F.startswith(form, F.lit("-")), "-").otherwise("").alias("sign"), digits.alias("digits"),
                    F.substring_index(form, "e", -1).cast("int").alias("power"))


def _number_from_parts(n: Column) -> Column:
    digits, power = n["digits"], n["power"]
    rest = F.substr(digits, power + 2)
    plain = F.when(power >= 0, F.concat(F.rpad(digits, power + 1, "0"), F.lit("."), F.when(F.length(rest) > 0, rest).otherwise("0"))
                   ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    tail = F.substring(digits, 2, 17)
    size = F.abs(power).cast("string")
    exponent = F.concat(F.substring(digits, 1, 1), F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"),
                        F.when(power < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
    return F.concat(n["sign"], F.when(power.between(-4, 15), plain).otherwise(exponent))


def row_json(df, cols: list[str] | None = None) -> Column:
    """A row as a JSON object, ``, `` and ``: `` between its parts, nulls kept."""
    kinds = dict(df.dtypes)
    parts = []
    for name in cols or df.columns:
        text = kinds[name] in ("string", "date") or kinds[name].startswith("timestamp")
        number = number_text(name) if kinds[name] in ("double", "float") else F.col(name).cast("string")
        value = json_text(name) if text else F.coalesce(number, F.lit("null"))
        parts += [F.lit(("{" if not parts else ", ") + f'"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


@lru_cache
def _latin1_table() -> tuple[str, str, dict[str, str]]:
    """What becomes of each code point by NFKD and then Latin-1: characters with
    one successor (last: Latin-1 ones without any), these successors, and those
    with several (``_folded_run`` finds them).  Marks, which alone are reordered by the normal form, never
    fit Latin-1, so a text folds character by character."""
    before, after, gone, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("latin-1", "ignore").decode("latin-1") if not 0xD800 <= code <= 0xDFFF else ""
        if len(folded) > 1:
            several[char] = folded
        elif folded and folded != char:
            before.append(char)
            after.append(folded)
        elif not folded and code <= 0xFF:                 # the micro sign is a Greek letter
            gone.append(char)
    return "".join(before + gone), "".join(after), several


@lru_cache
def _several_pages() -> tuple[str, str, str]:
    """Latin-1 characters that stay, as ranges of a pattern; page of each 256
    code points (0: none), and the successors by page and place, line by line."""
    several = {ord(c): folded for c, folded in _latin1_table()[2].items()}
    pages = sorted({code >> 8 for code in several})
    place = [pages.index(k) + 1 if k in pages else 0 for k in range((sys.maxunicode >> 8) + 1)]
    lines = [several.get((k << 8) + i, "") for k in pages for i in range(256)]
    edges = [-1, *sorted(code for code in several if code <= 0xFF), 0x100]
    kept = "".join(f"\\x{a + 1:02X}-\\x{b - 1:02X}" for a, b in zip(edges, edges[1:]) if b - a > 1)
    return kept, ",".join(map(str, place)), "\n".join(lines)


def _folded_run(run: Column) -> Column:
    """A run of characters that stay, or what becomes of any other character."""
    _, place, lines = _several_pages()
    code = F.ascii(run)                                      # code point of the first character
    page = F.element_at(F.split(F.lit(place), ",").cast("array<int>"), F.shiftright(code, 8) + 1)
    found = F.element_at(F.split(F.lit(lines), "\n"), (page - 1) * 256 + F.pmod(code, F.lit(256)) + 1)
    found = F.when((page > 0) & (F.length(found) > 0), found)
    return F.coalesce(found, F.when(code <= 0xFF, run).otherwise(""))


def _once(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _nfkd_latin1(c: Column) -> Column:
    before, after, _ = _latin1_table()
    kept = _several_pages()[0]
    return _once(F.translate(c, before, after), lambda single: F.when(single.rlike(f"[^{kept}]"), F.array_join(
        F.transform(F.regexp_extract_all(single, F.lit(f"[{kept}]+|[^{kept}]"), F.lit(0)), _folded_run), "")).otherwise(single))


@column_cache
def replace_typography(col) -> Column:
    """The fixed typographic replacements, JVM-side."""
    c = _c(col)
    for raw, rep in C.FOLD_REPLACEMENTS:
        c = F.replace(c, F.lit(raw), F.lit(rep))
    return c


@column_cache
def fold_text(col, width: int | None = None) -> Column:
    """Latin-1 safe text: cut to ``width`` first, then replacements, NFKD,
    and drop what latin-1 cannot hold."""
    c = _c(col).cast("string")
    if width is not None:
        c = F.substring(c, 1, width)
    # ASCII text is its own folding
    return _once(replace_typography(c), lambda plain: F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(_nfkd_latin1(plain)))
