"""Quality rules: a threshold table compiled into one projection of JVM expressions.

Words are maximal runs of characters other than space and \\t-\\r. All measures are
taken over the whole text; null counts as empty. No user function runs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.common import by_place, let, pick, place

SPACE = "[ \\t-\\r]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by this from or "
    "le la les de des et en un une du que pour dans qui sur au est pas plus par "
    "der die das und zu den von mit ist des im nicht ein eine als auf dem sich "
    "el los las que del se por con para una su al es lo como y"
).split()
# Positions in the packed sort key below: words of a text that the fast pass can number.
INDEX_BITS = 24


class Rule(NamedTuple):
    """A text passes if ``measure`` lies in [low, high]; a null bound is open."""
    name: str
    measure: str
    low: float | None
    high: float | None


#: Threshold table of the verdict, beside the base rules. Ratios are per word or per line.
RULES = (
    Rule("word_length", "word_chars / n_words", 1.5, 25.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.20),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.50),
)


def _neighbours_equal(items: Column, key) -> Column:
    """Items of a sorted array whose key equals that of the one before or after."""
    return let(items, lambda s: F.filter(s, lambda x, i: F.coalesce(key(x) == key(F.get(s, i - 1)), F.lit(False))
                                         | F.coalesce(key(x) == key(F.get(s, i + 1)), F.lit(False))))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Window hashes packed with their positions are sorted as longs; only windows
    whose hash repeats are then compared as text, so the count is exact.
    """
    def of_windows(windows: Column) -> Column:
        packed = F.transform(windows, lambda w, i: F.shiftleft(F.xxhash64(w), INDEX_BITS).bitwiseOR(i.cast("long")))
        hashed = _neighbours_equal(F.sort_array(packed), lambda x: F.shiftright(x, INDEX_BITS))
        likely = F.transform(hashed, lambda x: x.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).cast("int"))
        every = F.transform(windows, lambda w, i: i)
        at = F.when(F.size(windows) < (1 << INDEX_BITS), likely).otherwise(every)
        texts = F.sort_array(F.transform(at, lambda p: F.struct(F.get(windows, p).alias("w"), p.alias("p"))))
        repeated = _neighbours_equal(texts, lambda x: x["w"])
        return F.size(F.array_distinct(F.flatten(
            F.transform(repeated, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                          lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, of_windows)


def measures(text: Column) -> Column:
    """All measures of a text as one struct; null reads as empty, every measure is then 0."""
    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACE + "+"), "")
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
        symbols = F.length(F.regexp_replace(t, "[^#*$%&|<>]+", ""))

        def of_words(w: Column) -> Column:
            def of_lines(ls: Column) -> Column:
                return F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    symbols.cast("long").alias("n_symbols"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w).cast("long").alias("n_repeat_words"),
                    F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                    F.size(ls).cast("long").alias("n_lines"))
            return let(lines, of_lines)
        return let(words, of_words)
    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) from the measures struct ``m``; a text without words fails."""
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    passed = F.lit(True)
    for rule in rules:
        top, bottom = (m[x.strip()] for x in rule.measure.split("/"))
        ratio = F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        if rule.low is not None:
            passed = passed & (ratio >= rule.low)
        if rule.high is not None:
            passed = passed & (ratio <= rule.high)
    return base_failed, ~base_failed & passed


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, kept.

    Null and empty texts have no words: every measure is 0, base_failed true, kept
    false. A null id stays null; repeated rows each return a row; an empty table
    gives an empty result. Scan and projection only, no shuffle.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", measures(F.col("text")).alias("m"))
    base_failed, kept = verdict(F.col("m"), rules)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "m.*",
                       base_failed.alias("base_failed"), kept.alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text the rules keep."""
    flat = by_place(df).withColumn("_m", measures(place(df, text_col)))
    return flat.where(verdict(F.col("_m"), rules)[1]).drop("_m").toDF(*df.columns)
