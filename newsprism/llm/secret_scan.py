"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksums.

One automaton reads each whole text once. A pattern is tried only at a keyword hit
and only anchored there. The added kinds carry a checksum inside the secret and are
reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.common import by_place, pick, place, position, worker_state

# The kinds, their patterns and their least lengths; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "forge", "registry", "xprv")
BASE_KINDS = KINDS[:3]
PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                         re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "forge": re.compile(r"gh[opsur]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "registry": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}
HEX_HIT = 4
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
REPLACEMENT = "[SECRET]"


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def _crc62_holds(token: str) -> bool:
    """The last six base-62 digits are the crc32 of the thirty characters after the prefix."""
    value = 0
    for c in token[-6:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(token[4:-6].encode())


def _base58check_holds(key: str) -> bool:
    """The last four of the 82 bytes begin the double sha256 of the others."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    if value >> (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= LEAST[kind]
    if kind in LEAST:
        return len(match[0]) >= LEAST[kind]
    return _base58check_holds(match[0]) if kind == "xprv" else _crc62_holds(match[0])


def build_automaton() -> ahocorasick.Automaton:
    """Keywords with (kind, length): the assign words in every mix of case, the prefixes, every run of four hex digits."""
    words = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for cased in product(*({c, c.upper()} for c in word)):
            words.add_word("".join(cased), (0, len(word)))
    for kind, prefixes in ((1, ("AKIA",)), (3, [f"gh{c}_" for c in "opsur"]), (4, ("npm_",)), (5, ("xprv",))):
        for prefix in prefixes:
            words.add_word(prefix, (kind, len(prefix)))
    for run in product("0123456789abcdef", repeat=HEX_HIT):
        words.add_word("".join(run), (2, HEX_HIT))
    words.make_automaton()
    return words


def _automaton() -> ahocorasick.Automaton:
    """The worker's automaton, built once."""
    return worker_state("secret_scan", build_automaton)


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """Spans by start, then kind. Per kind leftmost and non-overlapping; a match that fails its check still takes its place.

    No keyword of a kind contains another of that kind, so hits by end are hits by start.
    """
    taken = [0] * len(KINDS)
    found = []
    for last, (kind, length) in automaton.iter(text):
        start = last + 1 - length
        if start < taken[kind]:
            continue
        match = PATTERNS[KINDS[kind]].match(text, start)
        if match:
            # an added kind that fails its checksum must not hide a secret that begins inside it
            good = _holds(KINDS[kind], match)
            if good or kind < len(BASE_KINDS):
                taken[kind] = match.end()
            if good:
                found.append(Span(start, kind, match.end()))
    return sorted(found)


def spans_column(text: Column) -> Column:
    """Spans of each text: array of (kind, start, end), code points, end exclusive; null reads as empty."""
    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for batch in batches:
            yield pd.Series([[{"kind": KINDS[s.kind], "start": s.start, "end": s.end}
                              for s in find_spans(t or "", automaton)] for t in batch], dtype=object)
    return scan(text)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, found (array of kind, start, end).

    Null and empty texts have no spans; ids may be null; repeated rows each return
    a row; an empty table gives an empty result. Scan and projection only.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"),
                       spans_column(F.col("text").cast("string")).alias("found"))


def describe(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined in order."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(text: str, automaton: ahocorasick.Automaton) -> str:
    parts, at = [], 0
    for span in find_spans(text, automaton):
        if span.end > at:
            if span.start >= at:
                parts += [text[at:span.start], REPLACEMENT]
            at = span.end
    return "".join([*parts, text[at:]]) if at else text


def redact(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with every secret (overlapping spans together) replaced; ``length_col``, if there, counts anew where text changed.

    Rows without secrets stay as they are, null texts included.
    """
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for batch in batches:
            yield pd.Series([None if t is None else _redacted(t, automaton) for t in batch], dtype=object)

    flat, text = by_place(df), place(df, text_col)
    flat = flat.withColumn("_clean", clean(text.cast("string")))
    same = F.col("_clean").eqNullSafe(text.cast("string"))
    out = []
    for i, name in enumerate(df.columns):
        column = F.col(f"_in{i}")
        if i == position(df, text_col):
            column = F.col("_clean")
        elif name.lower() == length_col.lower():
            column = F.when(same, column).otherwise(F.length("_clean").cast(df.schema.fields[i].dataType))
        out.append(column.alias(f"_out{i}"))
    return flat.select(*out).toDF(*df.columns)
