"""Scalar text expressions with Python ``str`` semantics, built from JVM functions.

Everything here returns a ``Column``; nothing runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must match Python's str.isspace(), which str.strip() and
# str.split() use): TAB, LF, VT, FF, CR, FS, GS, RS, US, SPACE, NEL, NBSP,
# OGHAM SPACE MARK, EN QUAD .. HAIR SPACE (U+2000..U+200A), LINE SEPARATOR,
# PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class, valid in both Java regex and RE2.
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
WORD_RUN = "[^" + WS_CLASS[1:] + "+"

# The four editorial markers and the prompt of the zero-shot
# classifier.
MARKERS = ("reuters", "featured image", "getty images", "twitter.com")
SYSTEM_PROMPT = (
    "You are a binary news classification system.\n"
    "Classify the news article as FAKE or REAL.\n"
    "Return ONLY one word: FAKE or REAL.\n"
    "Do not explain your answer and do not add punctuation."
)
USER_PROMPT_PREFIX = "Classify the following news article.\n\nARTICLE:\n"
LABEL_NAMES = {0: "Fake", 1: "Real"}
# Month and weekday names, whole or as their first letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _named(names: tuple[str, ...], shortest: int = 3) -> str:
    """Alternatives for names that may be cut after ``shortest`` letters or one more (sept, tues, thurs)."""
    return "|".join(f"{n[:shortest]}(?:{n[shortest]}(?:{n[shortest + 1:]})?)?" if len(n) > shortest + 1 else n[:shortest] + (
        f"(?:{n[shortest:]})?" if n[shortest:] else "") for n in names)


# The parts of a date string, lower-cased; patterns are valid in both Java regex and RE2.
_MONTH = f"(?:{_named(MONTHS)})"
_DAY, _YEAR, _TH = r"\d{1,2}", r"\d{4}|\d{2}", r"(?:st|nd|rd|th)?"
#: What is cut off a date: a weekday before it, a time of day with its zone after it.
WEEKDAY_PATTERN = rf"^(?:{_named(WEEKDAYS)}|thurs)\.?,?\s+"
TIME_PATTERN = r"(?:t|,?\s+(?:at\s+)?)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:am|pm)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
#: Orders of day (d), month number (m), month name (n) and year (y), each with the pattern of its groups.
DATE_PATTERNS = (
    ("ndy", rf"^({_MONTH})\.?[\s-]+({_DAY}){_TH},?[\s-]+({_YEAR})$"),
    ("dny", rf"^({_DAY}){_TH}(?:\s+of)?[\s-]*({_MONTH})\.?,?[\s-]*({_YEAR})$"),
    ("ynd", rf"^(\d{{4}})[\s-]+({_MONTH})\.?[\s-]+({_DAY})$"),
    ("ymd", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})$"),
    ("mdy", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"),
)
#: Two-digit years from here on belong to the last century (POSIX).
PIVOT = 69


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (not only spaces)."""
    return F.btrim(_c(col), F.lit(WHITESPACE_CHARS))


def clean_field(col) -> Column:
    """``fillna("").astype(str).str.strip()``."""
    return strip(F.coalesce(_c(col).cast("string"), F.lit("")))


def words(col) -> Column:
    """``str.split()``: whitespace-separated words, no empty strings."""
    return F.filter(F.split(_c(col), WS_RUN), lambda w: w != F.lit(""))


def word_count(col) -> Column:
    """``len(str.split())`` without materialising the word array."""
    return F.regexp_count(_c(col), F.lit(WORD_RUN)).cast("bigint")


def char_count(col, char: str) -> Column:
    """Occurrences of one literal character (``str.count``)."""
    escaped = "\\" + char if not char.isalnum() else char
    return F.regexp_count(_c(col), F.lit(escaped)).cast("bigint")


def is_upper_word(w: Column) -> Column:
    """``str.isupper()``: at least one uppercase letter and no lower/title-case letter."""
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]")


def uppercase_word_count(col) -> Column:
    return F.size(F.filter(words(col), is_upper_word)).cast("bigint")


def contains_ci(col, literal: str) -> Column:
    """Literal, case-insensitive substring test; null text gives False."""
    return F.coalesce(F.instr(F.lower(_c(col)), F.lit(literal.lower())) > 0, F.lit(False))


def matches_ci(col, pattern: str) -> Column:
    """Case-insensitive regex search; null text gives False."""
    return F.coalesce(_c(col).rlike("(?i)" + pattern), F.lit(False))


def build_content(title, text) -> Column:
    """``(title + " " + text).strip()``."""
    return strip(F.concat(_c(title), F.lit(" "), _c(text)))


def parse_date(col) -> Column:
    """The date that a string names; null for anything else and for days that do not exist.

    A small grammar: a weekday before the date and a time of day with its zone after it
    are cut off; the rest is cut into numbers and names by DATE_PATTERNS. In numeric dates
    the month comes first, unless the first number cannot be one (``31/12/2017``). Names
    may be short and in any case, days may be ordinals, two-digit years follow the POSIX
    pivot (69-99 -> 19xx, 00-68 -> 20xx). The zone does not move the date.
    """
    def parts_of(s: Column) -> Column:
        """year|month|day, then m for a month that stands first and may be a day; null where no pattern fits."""
        out = F.lit(None).cast("string")
        for order, pattern in reversed(DATE_PATTERNS):
            fields = "|".join(f"${order.index(k) + 1}" for k in ("y", "n" if "n" in order else "m", "d"))
            out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, fields + ("|m" if order == "mdy" else ""))).otherwise(out)
        return F.split(out, "[|]")

    def date_of(p: Column) -> Column:
        year, first, second = p[0].try_cast("int"), p[1].try_cast("int"), p[2].try_cast("int")
        year = F.when(F.length(p[0]) == 2, year + F.when(year >= PIVOT, 1900).otherwise(2000)).otherwise(year)
        swapped = (F.size(p) > 3) & (first > 12)
        named = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(p[1], 1, 3)).cast("int")
        month = F.when(first.isNull(), named).when(swapped, second).otherwise(first)
        text = F.format_string("%04d-%02d-%02d", year, month, F.when(swapped, first).otherwise(second))
        return F.when(year > 0, text.try_cast("date"))

    s = F.lower(strip(_c(col)))
    s = F.regexp_replace(F.regexp_replace(s, TIME_PATTERN, ""), WEEKDAY_PATTERN, "")
    parts = F.transform(F.array(s), parts_of)
    return F.get(F.transform(F.filter(parts, lambda p: p.isNotNull()), date_of), F.lit(0))


def decode_label(col) -> Column:
    expr = None
    for code, name in LABEL_NAMES.items():
        expr = (F.when(_c(col) == code, F.lit(name)) if expr is None
                else expr.when(_c(col) == code, F.lit(name)))
    return expr


def parse_binary_answer(col) -> Column:
    """strip + upper; prefix FAKE -> 0, REAL -> 1, anything else -> null."""
    norm = F.upper(strip(_c(col).cast("string")))
    return (F.when(norm.startswith("FAKE"), F.lit(0))
            .when(norm.startswith("REAL"), F.lit(1))
            .otherwise(F.lit(None).cast("int")))


def build_prompt(content) -> Column:
    """Chat message list: system instruction + the article as user message."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.lit(USER_PROMPT_PREFIX), _c(content)).alias("content")),
    )


def content_preview(col, n: int = 500) -> Column:
    return F.substring(_c(col), 1, n)


def correct_flag(prediction, label) -> Column:
    """prediction == label; a missing prediction counts as wrong."""
    return F.coalesce(_c(prediction) == _c(label), F.lit(False))
