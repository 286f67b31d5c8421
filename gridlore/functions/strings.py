"""String functions: places count from 0, and -1 means not found."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..plans.ek import template
from .vectors import once


def match(s: Column, pattern: str, any_string: str = "*", one_char: str = "%", ignore_case: bool = True) -> Column:
    regex = template(pattern, any_string, one_char)
    return s.rlike(regex if ignore_case else regex.replace("(?is)", "(?s)", 1))


def compress(s: Column, char: str, most: int) -> Column:
    """Runs of char cut to most."""
    return F.regexp_replace(s, f"({re.escape(char)}{{{most}}}){re.escape(char)}+" if most else f"{re.escape(char)}+", "$1" if most else "")


def same(a: Column, b: Column) -> Column:
    """Equal but for case and blanks."""
    plain = lambda x: F.upper(F.replace(x, F.lit(" "), F.lit("")))
    return plain(a) == plain(b)


def pos(s: Column, sub: str, start: int = 0) -> Column:
    return F.locate(sub, s, start + 1) - 1


def _until(s: Column, start: int | None) -> Column:
    """s up to and with a place, as searches backward see it."""
    return s if start is None else F.substring(s, 1, max(0, start + 1))


def pos_reverse(s: Column, sub: str, start: int | None = None) -> Column:
    """Last place where sub begins, at start or before it."""
    part = s if start is None else F.substring(s, 1, max(0, start + len(sub)))
    at = F.locate(sub[::-1], F.reverse(part))
    return F.when(at > 0, F.length(part) - at - len(sub) + 1).otherwise(-1)


def _first(s: Column, regex: str, start: int) -> Column:
    at = F.regexp_instr(F.substring(s, F.lit(start + 1), F.length(s)), F.lit(regex))
    return F.when(at > 0, at + start - 1).otherwise(F.when(s.isNotNull(), -1))


def _last(s: Column, regex: str, start: int | None) -> Column:
    part = _until(s, start)
    at = F.regexp_instr(F.reverse(part), F.lit(regex))
    return F.when(at > 0, F.length(part) - at).otherwise(F.when(s.isNotNull(), -1))


def char_pos(s: Column, chars: str, start: int = 0) -> Column:
    """First place of any of chars from start on."""
    return _first(s, f"[{re.escape(chars)}]", start)


def not_char_pos(s: Column, chars: str, start: int = 0) -> Column:
    return _first(s, f"[^{re.escape(chars)}]", start)


def char_pos_reverse(s: Column, chars: str, start: int | None = None) -> Column:
    """Last place of any of chars, at start or before it."""
    return _last(s, f"[{re.escape(chars)}]", start)


def not_char_pos_reverse(s: Column, chars: str, start: int | None = None) -> Column:
    return _last(s, f"[^{re.escape(chars)}]", start)


def last_nonblank(s: Column) -> Column:
    return F.length(F.rtrim(s)) - 1


def is_white(s: Column) -> Column:
    return s.rlike(r"^\s*$")


def items(s: Column, delimiters: str) -> Column:
    """List items between any of the delimiters, trimmed; empty items stay."""
    return F.transform(F.split(s, f"[{re.escape(delimiters)}]", -1), lambda x: F.trim(x))


def item_set(s: Column, delimiters: str) -> Column:
    return F.array_sort(F.array_distinct(items(s, delimiters)))


def nth_word(s: Column, n: int) -> Column:
    """The n-th blank-separated word from 1, or the empty string."""
    return F.coalesce(F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(n)), F.lit(""))


def after_keyword(s: Column, keyword: str, stops: list[str]) -> Column:
    """Text between a keyword and the next of the stop words (or the end)."""
    stop = "|".join([rf"\b{re.escape(x)}\b" for x in stops] + ["$"])
    return F.trim(F.regexp_extract(s, rf"(?is)\b{re.escape(keyword)}\b(.*?)(?:{stop})", 1))


def parse_double(s: Column) -> Column:
    """Null where the text is no number."""
    return s.try_cast("double")


def parse_int(s: Column) -> Column:
    return s.try_cast("long")


def replace_marker(s: Column, marker: str, value: Column) -> Column:
    """The first marker replaced by a value."""
    at = F.locate(marker, s)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), value.cast("string"), F.substring(s, at + len(marker), F.length(s)))).otherwise(s)


def number_at(s: Column) -> Column:
    """The signed decimal number that the string starts with, as text."""
    return F.regexp_extract(s, r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][-+]?\d+)?", 0)


def quoted_at(s: Column) -> Column:
    return F.regexp_extract(s, "^(\"(?:[^\"]|\"\")*\")", 1)


def unsigned_at(s: Column) -> Column:
    return F.regexp_extract(s, r"^\d+", 0)


def integer_at(s: Column) -> Column:
    return F.regexp_extract(s, r"^[-+]?\d+", 0)


def decimal_at(s: Column) -> Column:
    """The signed number without an exponent that the string starts with."""
    return F.regexp_extract(s, r"^[-+]?(?:\d+\.?\d*|\.\d+)", 0)


def next_word(s: Column) -> Column:
    """struct<next, rest>: the first blank-separated word and what follows it, left-justified."""
    return F.struct(F.regexp_extract(s, r"^\s*(\S*)", 1).alias("next"), F.regexp_extract(s, r"(?s)^\s*\S*\s*(.*)$", 1).alias("rest"))


# Fixed words of numbers.
ONES = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN".split()
TENS = "ZERO TEN TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()
POWERS = [(10**9, "BILLION"), (10**6, "MILLION"), (10**3, "THOUSAND"), (1, None)]
ORDINALS = {"ONE": "FIRST", "TWO": "SECOND", "THREE": "THIRD", "FIVE": "FIFTH", "EIGHT": "EIGHTH", "NINE": "NINTH", "TWELVE": "TWELFTH"}


def cardinal(n: Column) -> Column:
    """A whole number below 10^12 in size in English words."""
    ones, tens = (F.array(*[F.lit(w) for w in words]) for words in (ONES, TENS))

    def hundreds(k: Column) -> Column:
        r = k % 100
        pair = F.when(r < 20, F.get(ones, r.cast("int"))).otherwise(F.concat_ws("-", F.get(tens, F.floor(r / 10).cast("int")), F.when(r % 10 > 0, F.get(ones, (r % 10).cast("int")))))
        return F.concat_ws(" ", F.when(k >= 100, F.concat(F.get(ones, F.floor(k / 100).cast("int")), F.lit(" HUNDRED"))), F.when(r > 0, pair))

    size = F.abs(n.cast("long"))
    part = lambda p: F.floor(size / p) % 1000
    named = lambda word: lambda k: F.when(k > 0, F.concat_ws(" ", hundreds(k), F.lit(word)))
    groups = [once(part(p), named(word)) for p, word in POWERS]
    return F.when(n == 0, ONES[0]).when(n.isNotNull(), F.concat_ws(" ", F.when(n < 0, F.lit("NEGATIVE")), *groups))


def ordinal_text(n: Column) -> Column:
    """The ordinal of a whole number: its last word changes."""
    return once(cardinal(n), lambda words: F.concat(F.regexp_replace(words, "[A-Z]+$", ""), once(F.regexp_extract(words, "([A-Z]+)$", 1), _ordinal)))


def _ordinal(last: Column) -> Column:
    out = F.when(last.endswith("TY"), F.regexp_replace(last, "TY$", "TIETH")).otherwise(F.concat(last, F.lit("TH")))
    for plain, changed in ORDINALS.items():
        out = F.when(last == plain, changed).otherwise(out)
    return out


def in_case(s: Column, case: str) -> Column:
    """U: upper, L: lower, C: a capital first."""
    return {"U": F.upper(s), "L": F.lower(s), "C": once(s, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x)))))}[case]


def replace_cardinal(s: Column, marker: str, n: Column, case: str = "U") -> Column:
    return replace_marker(s, marker, in_case(cardinal(n), case))


def replace_ordinal(s: Column, marker: str, n: Column, case: str = "U") -> Column:
    return replace_marker(s, marker, in_case(ordinal_text(n), case))


def replace_number(s: Column, marker: str, x: Column, digits: int, form: str = "E") -> Column:
    """The marker replaced by a number with so many significant digits (E) or so many after the point (F)."""
    return replace_marker(s, marker, F.format_string(f"%.{digits - 1}E" if form == "E" else f"%.{digits}f", x.cast("double")))


def replace_logical(s: Column, marker: str, b: Column, case: str = "U") -> Column:
    return replace_marker(s, marker, in_case(b.cast("string"), case))
