"""Phrase collocations by vertically partitioned suffix subtrees.

Every phrase of up to DEPTH words is a path in the suffix tree of the corpus, cut off at
DEPTH words; its count is the sum over the leaves below. The tree is never built whole.
Prefixes are chosen so that each has at most ``budget`` occurrences: single words, two
words where one word is more frequent, three where a pair is. In the order of their
hashes they are cut into groups of about the budget, and every group's subtrees are
built by a task of its own: windows of DEPTH words that start with one of the group's
prefixes, sorted, so that a run of equal first words is a node.

No task needs the vocabulary. A word is a 64-bit hash of language and word; the exact
count of all words first checks that no two share one (else another seed is taken). Words
below the least count cannot be part of a phrase that reaches it: a bitmap of bounded size
over the frequent words' hashes leaves nearly all others out of the windows, and the exact
counts settle what it lets through. Equal windows of a task are counted before they are
shuffled, so copies of a passage arrive as one row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.common import pick
from newsprism.session import cut_lineage, drop_cut

DEPTH = 4
LEAST = 30
COVERED_PERCENT = 80
TOP = 2000
#: Occurrences that one prefix, and about what one group of prefixes, may have.
BUDGET = 1 << 20
#: Bits of the bitmap of frequent words: more words let more rare ones through, results stay the same.
BITMAP_BITS = 1 << 25
#: Distinct words and windows that a task holds before it passes its counts on.
HELD_WORDS, HELD_WINDOWS = 400_000, 1 << 20
#: Slices of a language's phrases that are ranked before the language as a whole.
SLICES = 64
UND = "und"
WORDS = [f"h{i}" for i in range(DEPTH)]
BREAK = b"."


def _byte_table() -> bytes:
    """Maps A-Z to a-z and every byte that ends a piece to BREAK; space and tab stay, as does all else."""
    ends = set(b".,;:!?\n\x0b\x0c\r")
    return bytes(b + 32 if 65 <= b <= 90 else BREAK[0] if b in ends else b for b in range(256))


TABLE = _byte_table()


def tokens(texts: list[str]) -> list[bytes]:
    """Words of the texts, one list, with BREAK between pieces; no word holds BREAK."""
    joined = BREAK.join(t.encode() for t in texts).translate(TABLE).replace(BREAK, b" . ")
    return [w for w in joined.replace(b"\t", b" ").split(b" ") if w]


def word_hash(lang: str, seed: int):
    """Hash of a word of the language: xxhash64 seeded by that of the language."""
    start = xxhash.xxh64_intdigest(lang, seed)
    return lambda words: np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(start)), dtype=np.uint64)


def _by_lang(batches: Iterator[pa.RecordBatch], chars: int = 1 << 21) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, about ``chars`` characters together; a text is never cut."""
    for batch in batches:
        held: dict[str, list[str]] = {}
        size: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size[lang] += len(text)
                if size[lang] >= chars:
                    yield lang, held.pop(lang)
                    size.pop(lang)
        yield from held.items()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, f) of all words and of BREAK, counted per task before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words = list(counts)
                for at in range(0, len(words), 50_000):
                    some = words[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                         _signed(word_hash(lang, seed)(some)), pa.array([counts[w] for w in some], pa.int64())],
                        ["lang", "word", "h", "f"])
        for lang, texts in _by_lang(batches):
            held.setdefault(lang, Counter()).update(tokens(texts))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from rows()
                held.clear()
        yield from rows()

    rows = docs.mapInArrow(count, "lang string, word string, h long, f long")
    return rows.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def distinct_hashes(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """The word counts, written, and a seed for which no two words, BREAK among them, have the same hash."""
    while True:
        counts = cut_lineage(word_counts(docs, seed))
        if not counts.groupBy("h").count().where("count > 1 or h = 0").limit(1).collect():
            return counts.where(F.col("word") != BREAK.decode()), seed
        drop_cut(counts)
        seed += 1


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the frequent words' hashes: at most ``bits`` / 8 bytes, whatever the number of words."""
    at = F.pmod("h", F.lit(bits)) + 1  # positions in Spark's bitmaps start at 1
    rows = frequent.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows.collect():
        part = np.frombuffer(r["m"], dtype=np.uint8)
        begin = (r["b"] - 1) * len(part)
        out[begin:begin + len(part)] = part[:len(out) - begin]
    return out


def mixed(window: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the first ``depth`` words of each window."""
    out = window[:, 0].copy()
    for d in range(1, depth):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + window[:, d]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Cutter:
    """Cuts texts into windows; knows the frequent words' bitmap and the prefixes that exceed the budget."""
    bitmap: np.ndarray
    seed: int
    hot: list[tuple[np.ndarray, np.ndarray]]  # for 1, 2, ... words: sorted hashes, words

    def windows(self, lang: str, texts: list[str]) -> np.ndarray:
        """DEPTH hashes for each occurrence of a word that another one follows; 0 after the end of a piece
        or before a word that the bitmap leaves out."""
        to_hash = word_hash(lang, self.seed)
        h = to_hash(tokens(texts))
        at = h & np.uint64(8 * len(self.bitmap) - 1)
        known = self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        h[(known == 0) | (h == to_hash([BREAK])[0])] = 0
        h = np.concatenate([h, np.zeros(DEPTH, dtype=np.uint64)])
        first = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
        out = np.empty((len(first), DEPTH), dtype=np.uint64)
        for d in range(DEPTH):
            out[:, d] = h[first + d]
            if d > 1:
                out[out[:, d - 1] == 0, d] = 0
        return out

    def is_hot(self, window: np.ndarray, depth: int) -> np.ndarray:
        """Whether the first ``depth`` words are a prefix over the budget: found by hash, confirmed by the words."""
        keys, words = self.hot[depth - 1]
        key = mixed(window, depth)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return (words[at] == window[:, :depth]).all(axis=1)

    def lengths(self, window: np.ndarray) -> np.ndarray:
        """Words of each window's prefix: the first that is within the budget."""
        out = np.ones(len(window), dtype=np.int64)
        for d in range(1, len(self.hot) + 1):
            out[(out == d) & self.is_hot(window, d)] = d + 1
        return out


def equal_rows(window: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with summed counts."""
    if not len(window):
        return window, count
    order = np.lexsort(window.T[::-1])
    window, count = window[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]).any(axis=1)]))
    return window[starts], np.add.reduceat(count, starts)


def _held(batches: Iterator[pa.RecordBatch], cutter: Cutter, choose) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, distinct windows, counts) of bounded stretches of a task; ``choose`` picks and cuts the windows."""
    held: dict[str, list] = {}
    size = 0

    def settled() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, parts in held.items():
            window, count = equal_rows(*map(np.concatenate, zip(*parts)))
            if len(window):
                yield lang, window, count

    for lang, texts in _by_lang(batches):
        window = choose(cutter.windows(lang, texts))
        held.setdefault(lang, []).append((window, np.ones(len(window), dtype=np.int64)))
        size += len(window)
        if size > HELD_WINDOWS:
            distinct = list(settled())
            size = sum(len(w) for _, w, _ in distinct)
            held = {lang: [(w, c)] for lang, w, c in distinct}
            if size > HELD_WINDOWS // 2:
                yield from distinct
                held, size = {}, 0
    yield from settled()


def prefix_counts(docs: DataFrame, cutter: Cutter, depth: int) -> DataFrame:
    """(lang, h0..., f) of the prefixes of ``depth`` words that extend one over the budget."""
    names = WORDS[:depth]

    def chosen(window: np.ndarray) -> np.ndarray:
        window = window[window[:, depth - 1] != 0]
        return window[cutter.is_hot(window, depth - 1), :depth]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, window, counts in _held(batches, cutter, chosen):
            for at in range(0, len(window), 50_000):
                some = window[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), *[_signed(np.ascontiguousarray(c)) for c in some.T],
                     pa.array(counts[at:at + 50_000])], ["lang", *names, "f"])
    rows = docs.mapInArrow(count, f"lang string, {', '.join(f'{n} long' for n in names)}, f long")
    return rows.groupBy("lang", *names).agg(F.sum("f").alias("f"))


def _key(names: list[str], bits: int) -> Column:
    """The top ``bits`` of the prefix's hash."""
    def worker(*words: pd.Series) -> pd.Series:
        window = np.stack([w.to_numpy().view(np.uint64) for w in words], axis=1)
        return pd.Series((mixed(window, len(words)) >> np.uint64(64 - bits)).astype(np.int64))
    return F.pandas_udf(worker, "long")(*names)


def group_cuts(prefixes: list[tuple[DataFrame, list[str]]], budget: int, total: int) -> tuple[np.ndarray, int]:
    """First buckets of the groups after the first, and the bits of a bucket.

    Buckets are equal ranges of the prefixes' hashes, some per budget. In their order a
    group is cut where the running sum of occurrences fills a budget: sums run inside
    range partitions and are offset by those of the partitions before. One number per
    group reaches the driver.
    """
    bits = min(62, 6 + max(1, math.ceil(total / budget)).bit_length())
    keyed = reduce(DataFrame.unionByName, [rows.select(_key(names, bits).alias("key"), "f") for rows, names in prefixes])
    buckets = keyed.groupBy("key").agg(F.sum("f").alias("f"))
    dealt = cut_lineage(buckets.repartitionByRange("key").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (dealt.groupBy("_p").agg(F.sum("f").alias("_n"))
               .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    running = F.sum("f").over(Window.partitionBy("_p").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    group = F.floor((F.coalesce(running, F.lit(0)) + F.col("_off")) / F.lit(budget))
    cuts = dealt.join(offsets, "_p").withColumn("_g", group).groupBy("_g").agg(F.min("key").alias("key")).collect()
    drop_cut(dealt)
    return np.array(sorted(r["key"] for r in cuts)[1:], dtype=np.uint64), bits


def subtrees(docs: DataFrame, cutter: Cutter, cuts: np.ndarray, bits: int, least: int) -> DataFrame:
    """(lang, h0..h3, size, f) of the nodes of two or more words from each prefix downwards that reach ``least``."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, window, count in _held(batches, cutter, lambda w: w):
            length = cutter.lengths(window)
            deep = (window != 0).sum(axis=1) >= length  # others end above their prefix
            window, count, length = window[deep], count[deep], length[deep]
            key = np.zeros(len(window), dtype=np.uint64)
            for d in np.unique(length).tolist():
                key[length == d] = mixed(window[length == d], d) >> np.uint64(64 - bits)
            group = np.searchsorted(cuts, key, side="right")
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if len(at):
                    packed = [window[at].tobytes(), count[at].astype("<i8").tobytes(), length[at].astype("u1").tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang], pa.string()), pa.array([int(group[at[0]])], pa.int64()),
                         *[pa.array([c], pa.binary()) for c in packed]], ["lang", "grp", "windows", "counts", "lengths"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
        window, count, length = read("windows", np.uint64).reshape(-1, DEPTH), read("counts", "<i8"), read("lengths", "u1")
        order = np.lexsort(window.T[::-1])
        window, count, length = window[order], count[order], length[order]
        paths, sizes, totals = [], [], []
        changed = np.zeros(len(window), dtype=bool)
        changed[0] = True
        for d in range(DEPTH):  # runs of equal first d + 1 words are the nodes of that depth, their leaves' sum the count
            changed[1:] |= window[1:, d] != window[:-1, d]
            starts = np.flatnonzero(changed)
            total = np.add.reduceat(count, starts)
            node = (total >= least) & (window[starts, d] != 0) & (length[starts] <= d + 1)
            if d:
                path = window[starts[node]]
                path[:, d + 1:] = 0
                paths.append(path)
                sizes.append(np.full(len(path), d + 1, dtype=np.int32))
                totals.append(total[node])
        path = np.concatenate(paths)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(path), pa.string()),
                         **{w: _signed(np.ascontiguousarray(c)) for w, c in zip(WORDS, path.T)},
                         "size": pa.array(np.concatenate(sizes)), "f": pa.array(np.concatenate(totals))})

    dealt = docs.mapInArrow(deal, "lang string, grp long, windows binary, counts binary, lengths binary")
    return dealt.groupBy("lang", "grp").applyInArrow(
        build, f"lang string, {', '.join(f'{w} long' for w in WORDS)}, size int, f long")


def _padded(prefixes: DataFrame, depth: int) -> DataFrame:
    return prefixes.select("lang", *WORDS[:depth], *[F.lit(0).cast("long").alias(n) for n in WORDS[depth:]],
                           F.lit(depth).alias("size"), "f")


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, bitmap_bits: int = BITMAP_BITS
                  ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact counts of the phrases of 1 to DEPTH words that occur ``least`` times or more in their language.

    ``docs`` has lang and text. Returns (lang, h0..h3, size, f), 0 beyond a phrase's end;
    those of them over the budget; (word, h) of the frequent words; (lang, n) with n all
    word occurrences. At most total / budget prefixes per depth, the groups' cuts and the
    bitmap reach the driver.
    """
    counts, seed = distinct_hashes(docs)
    frequent = counts.where(F.col("f") >= least)
    total = counts.agg(F.sum("f")).first()[0] or 0
    cutter = Cutter(_bitmap(frequent, bitmap_bits), seed, [])
    prefixes, within, heavy = frequent.select("lang", F.col("h").alias("h0"), "f"), [], []
    for depth in range(1, DEPTH + 1):
        names = WORDS[:depth]
        over = prefixes.where(F.col("f") > budget)
        rows = [tuple(r) for r in over.select(*names).collect()] if depth < DEPTH else []
        if rows:
            within.append((prefixes.where(F.col("f") <= budget), names))
            heavy.append(_padded(over, depth))
            words = np.array(rows, dtype=np.int64).view(np.uint64).reshape(-1, depth)
            key = mixed(words, depth)
            order = np.argsort(key)
            cutter.hot.append((key[order], words[order]))
            prefixes = cut_lineage(prefix_counts(docs, cutter, depth + 1))
        else:
            within.append((prefixes, names))
            break
    cuts, bits = group_cuts(within, budget, total)
    trees = subtrees(docs, cutter, cuts, bits, least)
    single = _padded(frequent.select("lang", F.col("h").alias("h0"), "f"), 1)
    phrases = cut_lineage(reduce(DataFrame.unionByName, [trees, single, *heavy[1:]]))
    none = single.where(F.lit(False))
    return (phrases, reduce(DataFrame.unionByName, heavy, none), frequent.select("word", "h"),
            counts.groupBy("lang").agg(F.sum("f").alias("n")))


def _parts(size: int) -> list[tuple[int, int]]:
    """(start, end) of the contiguous parts of 2 words or more, the whole left out."""
    return [(a, b) for a in range(size) for b in range(a + 2, size + 1) if b - a < size]


def _path(start: int, end: int) -> list[Column]:
    """The words from ``start`` to ``end`` of a phrase, as a phrase of its own (at most DEPTH - 1 words)."""
    return [F.col(WORDS[start + i]) if start + i < end else F.lit(0).cast("long") for i in range(DEPTH - 1)]


def mine(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
         covered_percent: int = COVERED_PERCENT, budget: int = BUDGET, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 4 words.

    A phrase occurs ``least`` times or more; its score is the least of
    floor(2000000 * a / (l + r)) over its cuts (ties to the earliest cut), worked out in
    decimals. Phrases inside a longer candidate with ``covered_percent`` of their count or
    more go. Order: score, then a, both descending, then the phrase's bytes.

    A null language reads as ``und``, a null text as empty. Whole texts count; repeated
    rows count each; an empty table gives an empty result. ``bitmap_bits`` is a power of two.
    """
    if bitmap_bits & (bitmap_bits - 1) or bitmap_bits < 8:
        raise ValueError("bitmap_bits must be a power of two")
    docs = pick(df, lang=lang_col, text=text_col).select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.col("text").cast("string").alias("text"))
    phrases, heavy, words, totals = phrase_counts(docs, least, budget, bitmap_bits)
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    path = WORDS[:DEPTH - 1]

    def inside(ranges) -> Column:
        """Array of (k, side, words) or of parts, for phrases of each size."""
        sized = [F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *[c.alias(f"p{i}") for i, c in enumerate(_path(a, b))])
                           for k, side, a, b in ranges(size)]) for size in range(2, DEPTH + 1)]
        out = sized[-1]
        for size in range(DEPTH - 1, 1, -1):
            out = F.when(F.col("size") == size, sized[size - 2]).otherwise(out)
        return out

    cuts = inside(lambda size: [x for k in range(1, size) for x in ((k, 0, 0, k), (k, 1, k, size))])
    asked = candidates.select("lang", *WORDS, "size", "a", F.inline(cuts))
    key = [f"p{i}" for i in range(DEPTH - 1)]
    known = lambda rows: rows.where(F.col("size") < DEPTH).select(*[F.col(w).alias(p) for w, p in zip(path, key)], "f")
    # parts over the budget, at most total / budget of them, are what many phrases share
    answered = asked.join(F.broadcast(known(heavy)), key, "left")
    rest = answered.where("f is null").drop("f").join(known(phrases), key)
    answered = answered.where("f is not null").unionByName(rest)
    value = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    cut = answered.groupBy("lang", *WORDS, "size", "a").agg(
        *[value(k, side).alias(f"{name}{k}") for k in range(1, DEPTH) for side, name in ((0, "l"), (1, "r"))])
    score = lambda k: F.expr(f"cast(cast(a as decimal(20,0)) * 2000000 div (l{k} + r{k}) as long)")
    best = F.array_min(F.filter(F.array(*[
        F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        for k in range(1, DEPTH)]), lambda s: s["score"].isNotNull()))
    scored = cut.select("lang", *WORDS, "size", "a", best.alias("best"))

    longer = (candidates.where("size > 2").select("a", F.inline(inside(lambda size: [(0, 0, a, b) for a, b in _parts(size)] or [(0, 0, 0, size)])))
              .groupBy(*key).agg(F.max("a").alias("cover")))
    longer = longer.select(*[F.col(p).alias(w) for w, p in zip(path, key)], "cover")
    short = F.col(WORDS[-1]) == 0  # a phrase of DEPTH words lies in none
    covered = scored.where(short).join(longer, path, "left").where(
        F.col("cover").isNull() | (F.expr("cast(cover as decimal(20,0)) * 100") < F.expr(f"cast(a as decimal(20,0)) * {covered_percent}")))
    left = covered.drop("cover").unionByName(scored.where(~short))

    left = left.withColumn("_slice", F.pmod(F.xxhash64(*WORDS), F.lit(SLICES)))
    for keys in (("lang", "_slice"), ("lang",)):  # ties stay until the phrase itself is known
        order = Window.partitionBy(*keys).orderBy(F.desc("best.score"), F.desc("a"))
        left = left.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= top)
    spelt = left.select("lang", *WORDS, "a", "best", F.posexplode(F.array(*WORDS)).alias("at", "h")).where("h != 0")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ")
    spelt = spelt.join(words, "h").groupBy("lang", *WORDS, "a", "best").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
