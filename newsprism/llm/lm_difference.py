"""Cross-entropy difference: per-token loss under a target model less that under a background model.

Both models are bigram models over every word of the corpus; words and bigrams are
counted exactly, whatever their number. The loss of word w after c is
-ln((bigram(c, w) + MIX * p(w)) / (context(c) + MIX)) with p(w) = (count(w) + 1) /
(all words + distinct words + 1); the first word of a text has the loss -ln p(w). A
document's score is its mean loss under the target model less its mean loss under the
background model: the lower, the more it resembles the target. Counts cover every
document.

What is counted grows with the corpus and stays distributed. The HOT most frequent words
have small numbers, all others a 63-bit hash that is checked to tell all words apart.
The counts of hot words, of bigrams of the PAIRED most frequent ones, and of the other
bigrams that are frequent, are exact and reach the driver; their part of a loss needs no
shuffle. All other words of a text go once to the bucket of their word (of their bigram,
where the word is hot): a bucket then holds every occurrence of its bigrams and of its
rare words, so it counts and scores them in one go, and only sums per text come back.
No key of a bucket is hot: a rare word has at most 1 / HOT of all tokens, a bigram that
is not counted apart at most 1 / FREQUENT of them or an eighth of a bucket.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsprism.llm.common import pick, worker_state
from newsprism.session import cut_lineage, drop_cut

#: Words of the shared vocabulary and their greatest length: no bound.
VOCABULARY = sys.maxsize
LONGEST_WORD = sys.maxsize
#: Smoothing mass.
MIX = 50.0
#: Words with small numbers, and those whose bigrams are counted densely (results do not depend on either).
HOT = (1 << 16) - 1
PAIRED = 1 << 9
#: Bigrams with a larger share of the tokens than 1 / FREQUENT are counted apart (results do not depend on it).
FREQUENT = 1 << 16
#: Distinct words counted, words held for one round of blocks, rare words remembered, words per bucket.
HELD_WORDS = 300_000
HELD_TOKENS = 1 << 20
REMEMBERED = 300_000
BUCKET_TOKENS = 1 << 21
UNKNOWN = 0
#: Hashed words have the top bit; START stands for the context of a text's first word.
RARE = np.uint64(1 << 63)
START = np.uint64(1 << 62)


@dataclass
class Numbering:
    """Numbers of words: 1 and up for the hot ones; others a salted hash, or UNKNOWN if the vocabulary is closed."""
    hot: dict[str, int] = field(repr=False)
    size: int
    closed: bool = False
    salt: int = 0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Numbers(dict):
    """Number of each word inside one worker; rare words are hashed when met."""

    def __init__(self, numbering: Numbering):
        super().__init__(numbering.hot)
        self.numbering = numbering

    def __missing__(self, word: str) -> int:
        if self.numbering.closed:
            return UNKNOWN
        if len(self) > len(self.numbering.hot) + REMEMBERED:
            self.clear()
            self.update(self.numbering.hot)
        self[word] = number = rare_number(word, self.numbering.salt)
        return number

    def of(self, text: str) -> np.ndarray:
        tokens = text.lower().split()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def rare_number(word: str, salt: int) -> int:
    digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest, "little") | 1 << 63


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return pick(df, text=text_col).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, counted in the tasks before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(text.as_py().lower().split())
                if len(held) >= HELD_WORDS:
                    yield pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
                    held = Counter()
        yield pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _clash(words: DataFrame, salt: int) -> bool:
    """Whether two of the words have the same hash."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([rare_number(w, salt) for w in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.record_batch({"number": pa.array(ids.view(np.int64))})
    return not words.mapInArrow(number, "number long").groupBy("number").count().where("count > 1").isEmpty()


def learn_numbering(texts: DataFrame, size: int = VOCABULARY) -> tuple[Numbering, int]:
    """Numbers for all words, or the ``size - 1`` most frequent ones (ties by word), and the number of all tokens.

    At most HOT words reach the driver. A histogram of the counts gives the least count
    that gets in, so that tasks send only words at or above it.
    """
    counted = cut_lineage(word_counts(texts))
    distinct, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    closed = distinct > size - 1
    if closed and size - 1 > HOT:
        raise ValueError(f"a vocabulary smaller than that of the corpus holds at most {HOT + 1} words")
    most = min(size - 1, HOT)
    tally = counted.groupBy("n").agg(F.count("*").alias("words"))
    # one row per distinct count: at most the square root of twice the tokens
    above = F.coalesce(F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = tally.withColumn("above", above).where(F.col("above") < most).agg(F.min("n")).first()[0]
    top = counted.where(F.col("n") >= (least or 0)).orderBy(F.desc("n"), "word").limit(most).select("word").collect()
    numbering = Numbering({r["word"]: i for i, r in enumerate(top, 1)}, min(distinct, size - 1) + 1, closed)
    # only the hashed words must differ, but to check all spares a join; a clash takes the next hash
    while not closed and distinct > len(top) and _clash(counted.select("word"), numbering.salt):
        numbering.salt += 1
    drop_cut(counted)
    return numbering, tokens


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte by byte and compressed, after their length."""
    planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in columns])
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, columns: int = 1) -> list[np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.Codec("zstd").decompress(packed[8:], decompressed_size=n * 8 * columns, asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def numbered(df: DataFrame, numbering: Numbering, target_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, target, ids) of every row: the numbers of its words, and whether doc_id is in ``target_ids`` (id).

    The packed numbers, not the texts, are what the join shuffles.
    """
    shared = df.sparkSession.sparkContext.broadcast(numbering)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state(shared.value.key, lambda: Numbers(shared.value))
        for batch in batches:
            ids = [_pack(known.of(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ids = target_ids.select(F.col("id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # rows without an id get a key of their own, which meets none, so that they are spread
    flags = ids.select(F.col("doc_id").alias("_key"), F.lit(True).alias("_named"), F.lit(True).alias("target")).hint("merge")
    named = F.col("doc_id").isNotNull()
    keyed = rows.mapInArrow(number, "doc_id long, ids binary").withColumns(
        {"_key": F.when(named, F.col("doc_id")).otherwise(F.monotonically_increasing_id()), "_named": named})
    return keyed.join(flags, ["_key", "_named"], "left").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("target", F.lit(False)).alias("target"), "ids")


def _buckets(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number of its own for each bigram of hot words."""
    return before.astype(np.int64) << 32 | after.astype(np.int64)


def _places(frequent: np.ndarray, paired: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where each bigram is counted: in the square of the PAIRED words, then by its place in ``frequent``; -1 for all others."""
    place = np.full(len(before), -1, dtype=np.int64)
    near = (before < paired) & (after < paired)
    place[near] = before[near].astype(np.int64) * paired + after[near].astype(np.int64)
    if len(frequent):
        other = np.flatnonzero(~near & (before <= HOT) & (after <= HOT))
        key = _buckets(before[other], after[other])
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        hit = frequent[at] == key
        place[other[hit]] = paired * paired + at[hit]
    return place


def frequent_pairs(rows: DataFrame, tokens: int) -> np.ndarray:
    """Sorted keys of the bigrams of hot words, outside the PAIRED square, that are counted apart.

    All bigrams that occur ``least`` times or more are among them. A task hands on those
    that reach their share of ``least`` / 2 within a stretch of HELD_TOKENS words, so less
    than ``least`` / 2 of any bigram stays behind; sums below ``least`` / 2 are no
    candidates. That leaves 2 * FREQUENT keys at most, however large the corpus is.
    """
    paired, least = PAIRED, max(tokens / FREQUENT, BUCKET_TOKENS / 8)

    def found(held: list[np.ndarray], size: int) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        enough = n * 2.0 * tokens >= least * size
        return pa.record_batch({"key": pa.array(keys[enough]), "n": pa.array(n[enough].astype(np.int64))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                ids = _unpack(packed)[0]
                before, after = ids[:-1], ids[1:]
                far = (before <= HOT) & (after <= HOT) & ((before >= paired) | (after >= paired))
                held.append(_buckets(before[far], after[far]))
                size += len(ids)
                if size >= HELD_TOKENS:
                    yield found(held, size)
                    held, size = [], 0
        if held:
            yield found(held, size)
    sums = rows.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["key"] for r in sums.where(F.col("n") >= least / 2).collect()), dtype=np.int64)


@dataclass
class Model:
    """Per model (target, background): all words, hot words by number, bigrams by their place (``_places``)."""
    size: int
    totals: np.ndarray
    singles: np.ndarray = field(repr=False)
    pairs: np.ndarray = field(repr=False)
    paired: int
    frequent: np.ndarray = field(repr=False)

    def places(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return _places(self.frequent, self.paired, before, after)

    def chance(self, m: int, count: np.ndarray) -> np.ndarray:
        """p(w) of words that model ``m`` counted so often."""
        return (count + 1) / (self.totals[m] + self.size)


def fit(rows: DataFrame, numbering: Numbering, tokens: int) -> Model:
    """Counts of hot words and of bigrams with a place, over ``numbered`` rows and over the target's.

    Each task sums into arrays of fixed size and hands on what it counted.
    """
    size, paired, frequent = len(numbering.hot) + 1, PAIRED, frequent_pairs(rows, tokens)
    width = size + paired * paired + len(frequent) + 1
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, width), dtype=np.int64)
        for batch in batches:
            for target, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _unpack(packed)[0]
                hot = ids[ids < RARE].astype(np.int64)
                place = _places(shared.value, paired, ids[:-1], ids[1:])
                at = size + place[place >= 0]
                for m in (0, 1) if target else (1,):
                    np.add.at(both[m], hot, 1)
                    np.add.at(both[m], at, 1)
                    both[m, -1] += len(ids)
        at = np.flatnonzero(both)
        yield pa.record_batch({"at": pa.array(at), "n": pa.array(both.ravel()[at])})
    found = rows.select("target", "ids").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(2 * width)
    both[found["at"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    both = both.reshape(2, width)
    return Model(numbering.size, both[:, -1], both[:, :size], both[:, size:-1], paired, frequent)


def near_losses(rows: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, n_tokens, target, background): of each text's summed losses the part that the model alone gives."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = np.zeros((2, batch.num_rows))
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for i, packed in enumerate(batch.column(2).to_pylist()):
                ids = _unpack(packed)[0]
                sizes[i] = len(ids)
                if not len(ids):
                    continue
                context = ids[:-1][ids[:-1] < RARE].astype(np.int64)
                place = known.places(ids[:-1], ids[1:])
                after, place = ids[1:][place >= 0].astype(np.int64), place[place >= 0]
                for m in (0, 1):
                    single = known.singles[m]
                    out[m, i] = (np.log(single[context] + MIX).sum() - np.log(
                        known.pairs[m][place] + MIX * known.chance(m, single[after])).sum())
                    if ids[0] < RARE:
                        out[m, i] -= np.log(known.chance(m, single[int(ids[0])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(out[0]), pa.array(out[1])],
                                             names=["row", "doc_id", "n_tokens", "target", "background"])
    return rows.select("row", "doc_id", "ids").mapInArrow(add, "row long, doc_id long, n_tokens long, target double, background double")


def _mixed(numbers: np.ndarray) -> np.ndarray:
    mixed = numbers * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _blocks(held: list[tuple[int, bool, np.ndarray]], stretch: int, keys: np.ndarray, model: Model) -> pa.RecordBatch:
    """One packed block per bucket and ``stretch`` of texts of the words that ``near_losses`` leaves: word, word before, and 4 * row + 2 * target + not last."""
    sizes = np.array([len(ids) for *_, ids in held])
    word = np.concatenate([ids for *_, ids in held])
    last = np.cumsum(sizes) - 1
    before = np.roll(word, 1)
    before[last - sizes + 1] = START
    text = np.repeat(np.array([4 * row + 2 * target for row, target, _ in held], dtype=np.uint64), sizes) + np.uint64(1)
    text[last] -= np.uint64(1)
    rare = word >= RARE
    far = rare | ((before != START) & (model.places(before, word) < 0))
    word, before, text, rare = word[far], before[far], text[far], rare[far]
    bucket = _mixed(np.where(rare, word, word ^ _mixed(before))) % np.uint64(len(keys))
    order = np.lexsort((before, word, bucket))
    word, before, text, bucket = word[order], before[order], text[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    packed = [_pack(word[a:b], before[a:b], text[a:b]) for a, b in zip(cuts, ends)]
    return pa.record_batch({"bucket": pa.array(keys[bucket[cuts].astype(np.int64)], pa.int32()),
                            "stretch": pa.array(np.full(len(packed), stretch), pa.int64()), "block": pa.array(packed, pa.binary())})


def _score_bucket(model: Model, word: np.ndarray, before: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, summed losses per model) of a bucket's words, which are all of their bigrams and of the rare words."""
    order = np.lexsort((before, word))
    word, before, text = word[order], before[order], text[order]
    target = ((text >> np.uint64(1)) & np.uint64(1)).astype(np.float64)
    new_word = np.r_[True, word[1:] != word[:-1]]
    new_pair = new_word | np.r_[True, before[1:] != before[:-1]]
    of_word, of_pair = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
    rare, first = word >= RARE, before == START
    context = rare & ((text & np.uint64(1)) == 1)
    rows, owner = np.unique(text >> np.uint64(2), return_inverse=True)
    sums = np.zeros((2, len(rows)))
    for m, weight in enumerate((target, None)):
        pair = np.bincount(of_pair, weight)[of_pair]
        single = np.bincount(of_word, weight)[of_word].astype(np.float64)
        single[~rare] = model.singles[m][word[~rare].astype(np.int64)]
        chance = model.chance(m, single)
        loss = -np.log(np.where(first, chance, pair + MIX * chance)) + np.where(context, np.log(single + MIX), 0.0)
        sums[m] = np.bincount(owner, loss, len(rows))
    return rows.astype(np.int64), sums


def _even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """One key for each of the ``n`` partitions that a hash of the key deals to."""
    found = spark.range(32 * n).selectExpr("cast(id as int) k").groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k"))
    return np.array(sorted(r[1] for r in found.collect()), dtype=np.int32)


def far_losses(rows: DataFrame, model: Model, tokens: int) -> DataFrame:
    """(row, target, background): sums of the losses that need counts beyond the model's, one row per text.

    A task deals its texts in stretches of HELD_TOKENS words; a bucket returns one packed
    array per stretch, and the arrays of a stretch, which hold no more numbers than it
    has words, are added up together.
    """
    spark = rows.sparkSession
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    keys, shared = _even_keys(spark, buckets), spark.sparkContext.broadcast(model)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, stretch = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, target, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _unpack(packed)[0]
                if len(ids):
                    held.append((row, target, ids))
                    waiting += len(ids)
                if waiting >= HELD_TOKENS:
                    yield _blocks(held, stretch, keys, shared.value)
                    held, waiting, stretch = [], 0, stretch + 1
        if held:
            yield _blocks(held, stretch, keys, shared.value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, stretches, owners = [], [], []
        for batch in batches:
            for stretch, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append(_unpack(block, 3))
                own = np.unique(parts[-1][2] >> np.uint64(2)).astype(np.int64)
                owners.append(own)
                stretches.append(np.full(len(own), stretch))
        if not parts:
            return
        found, sums = _score_bucket(shared.value, *(np.concatenate(c) for c in zip(*parts)))
        owner, first = np.unique(np.concatenate(owners), return_index=True)  # the same rows as ``found``
        of = np.concatenate(stretches)[first]
        order = np.argsort(of, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(at):
                yield pa.record_batch({"stretch": pa.array([int(of[at[0]])], pa.int64()), "sums": pa.array(
                    [_pack(found[at].view(np.uint64), sums[0][at].view(np.uint64), sums[1][at].view(np.uint64))], pa.binary())})

    def per_text(table: pa.Table) -> pa.Table:
        row, target, background = (np.concatenate(c) for c in zip(*[_unpack(x, 3) for x in table.column("sums").to_pylist()]))
        texts, owner = np.unique(row.view(np.int64), return_inverse=True)
        return pa.table({"row": pa.array(texts), "target": pa.array(np.bincount(owner, target.view(np.float64), len(texts))),
                         "background": pa.array(np.bincount(owner, background.view(np.float64), len(texts)))})

    dealt = rows.select("row", "target", "ids").mapInArrow(deal, "bucket int, stretch long, block binary").repartition(buckets, "bucket")
    sums = dealt.select("stretch", "block").mapInArrow(add, "stretch long, sums binary")
    return sums.groupBy("stretch").applyInArrow(per_text, "row long, target double, background double")


def score(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss, score (their difference).

    Null and empty texts have no words: losses and score 0. Null ids are scored but
    never in the target. Repeated rows count and return each. Without a target its
    model is the smoothing alone; an empty table gives an empty result. With a
    ``vocabulary`` smaller than that of the corpus (HOT + 1 at most), all but its
    most frequent words are one unknown word. Texts are cut into words twice (counts,
    numbers); the numbers are written once and feed the models and the scores. A bigram or
    word that has a third of all tokens is counted apart and fills no bucket.
    """
    numbering, tokens = learn_numbering(_texts(df, text_col), vocabulary)
    rows = cut_lineage(numbered(df, numbering, target_ids, id_col, text_col))
    model = fit(rows, numbering, tokens)
    far = far_losses(rows, model, tokens).selectExpr("row", "cast(null as long) doc_id", "0L n_tokens", "target", "background")
    summed = near_losses(rows, model).unionByName(far).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        *[F.sum(m).alias(m) for m in ("target", "background")])
    mean = {m: F.when(F.col("n_tokens") > 0, F.col(m) / F.col("n_tokens")).otherwise(0.0) for m in ("target", "background")}
    return summed.select("doc_id", "n_tokens", mean["target"].alias("target_loss"), mean["background"].alias("background_loss"),
                         (mean["target"] - mean["background"]).alias("score"))
