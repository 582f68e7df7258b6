"""Language identification: a linear-chain conditional random field that labels words.

Words are white-space separated and reduced to their lower-case letters; those
without letters are left out. A word's potentials come from its affixes (up to
three letters), its character bigrams and trigrams (averaged), the learned lexicon
(the word itself, and the languages it was seen in) and a bias; transitions between
neighbouring labels are learned with them. Half of the training chains are stitched
from stretches of two languages, so that the transitions learn to switch.

Forward-backward gives each word's label probabilities; a document's language is the
one of highest mean probability, and that mean is its score. Chains are stretches of
at most CHAIN words; every word of a text lies in exactly one.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.common import by_place, crc_remainder, pick, place, worker_state
from newsprism.llm.words import WordRows, balanced_sample, stretches

CHAIN = 64
#: Bounds of the training sample: documents per language, and stretches of CHAIN words per document.
DOCS_PER_LANG = 150
STRETCHES_PER_DOC = 8
ROUNDS = 40
RATE = 0.15
DECAY = 1e-4
#: Features of value 1 per word: the word, its affixes and its lexicon entry; and the value of all inner n-grams together.
FIXED = 8
GRAM_VALUE = 3.0
#: Words of one forward-backward pass.
PASS_WORDS = 1 << 18
UNDETERMINED = "und"
#: What a text in a language has, once it has JUDGED_WORDS words of letters: a score this far above chance (0) towards
#: certainty (1), and this share of the support that all but one in a hundred of the learned stretches have.
#: The least score of the clean documents of sf0.01 is 0.38 above chance, an even mix of the four languages has 0.03.
JUDGED_WORDS = 20
MARGIN = 0.2
SUPPORT_SHARE = 0.5
#: Stretches of a language, of at least half a chain each, from which its support is learned; with fewer there is no bound.
SUPPORT_STRETCHES = 30
_NO_LETTER = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    features: dict[str, int] = field(repr=False, default_factory=dict)
    weights: np.ndarray = field(repr=False, default=None)
    transitions: np.ndarray = field(repr=False, default=None)
    lexicon: dict[str, int] = field(repr=False, default_factory=dict)
    #: per language, the least share of words in its lexicon
    supports: np.ndarray = field(repr=False, default=None)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def letters(word: str) -> str:
    """The letters of a word; figures that are no digits (fractions, numerals) go too."""
    core = _NO_LETTER.sub("", word)
    return core if core.isalpha() else "".join(filter(str.isalpha, core))


def _keys(words: list[str], lexicon: dict[str, int]) -> tuple[list[str], list[str], np.ndarray]:
    """Feature keys of words of letters: FIXED per word, then the inner n-grams and their number per word.

    Keys keep apart by their edge marks: ``^`` begins a prefix or word, ``$`` ends a
    suffix or word, lexicon entries are marked the other way round. "" is no feature.
    """
    fixed, grams, sizes = [], [], []
    for word in words:
        edged = f"^{word}$"
        fixed += (edged, edged[:2], edged[:3], edged[:4], edged[-2:], edged[-3:], edged[-4:],
                  f"${lexicon.get(word, 0)}^")
        n = len(word)
        if n > 1:
            grams += [word[i:i + 2] for i in range(n - 1)]
            grams += [word[i:i + 3] for i in range(n - 2)]
            sizes.append(2 * n - 3)
        else:
            grams.append("")
            sizes.append(1)
    return fixed, grams, np.array(sizes, dtype=np.int64)


def _potentials(weights: np.ndarray, fixed: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Potential of each word and label: the fixed features, and the mean n-gram GRAM_VALUE times."""
    mean = np.add.reduceat(weights[grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    return weights[fixed].sum(axis=1) + GRAM_VALUE * mean


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Label probabilities (time, label, chain) of chains sorted by descending length.

    ``emission`` holds exp(potential), padded with ones; with ``pairs`` also the
    expected transition counts.
    """
    steps, labels, _ = emission.shape
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # chains longer than t
    alpha = np.zeros_like(emission)
    scale = np.ones((steps, emission.shape[2]), dtype=emission.dtype)
    for t in range(steps):
        n = active[t]
        a = emission[t, :, :n] if t == 0 else (transition.T @ alpha[t - 1, :, :n]) * emission[t, :, :n]
        scale[t, :n] = a.sum(axis=0)
        np.divide(a, scale[t, :n], out=alpha[t, :, :n])
    marginal = np.ones_like(emission)
    expected = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = emission[t + 1, :, :n] * marginal[t + 1, :, :n]
        ahead /= scale[t + 1, :n]
        np.matmul(transition, ahead, out=marginal[t, :, :n])
        if pairs:
            expected += (alpha[t, :, :n] @ ahead.T) * transition
    marginal *= alpha
    return (marginal, expected) if pairs else marginal


def _pad(lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of consecutive chains as (time, label, chain), longest first; also time and chain of each row."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    chain = np.repeat(rank, lengths)
    time = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded = np.ones((int(lengths.max()), values.shape[1], len(lengths)), dtype=values.dtype)
    for k in range(values.shape[1]):
        padded[time, k, chain] = values[:, k]
    return padded, time, chain


def train(samples: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> Model | None:
    """Fit on (language, words) stretches by full-gradient Adam; None without samples. Repeatable."""
    samples = sorted((lang, words) for lang, words in samples if words)
    if not samples:
        return None
    langs = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(langs)}
    model = Model(langs)
    counts = Counter((w, number[lang]) for lang, words in samples for w in words)
    for (word, lang), n in counts.items():
        if n >= 3:
            model.lexicon[word] = model.lexicon.get(word, 0) | 1 << lang

    mixed = np.random.default_rng(7).permutation(len(samples))
    chains: list[tuple[list[str], list[int]]] = []
    for i, at in enumerate(mixed):
        lang, words = samples[at]
        if i % 2 and chains:  # half of this stretch follows half of the one before
            before, tags = chains.pop()
            cut, own = len(before) // 2, words[:max(1, len(words) // 2)]
            chains += [(before[:cut] + own, tags[:cut] + [number[lang]] * len(own)),
                       (words[len(own):] + before[cut:],
                        [number[lang]] * (len(words) - len(own)) + tags[cut:])]
        else:
            chains.append((words, [number[lang]] * len(words)))
    chains = sorted((c for c in chains if c[0]), key=lambda c: -len(c[0]))

    types: dict[str, int] = {}
    token = np.array([types.setdefault(w, len(types)) for words, _ in chains for w in words], dtype=np.int64)
    tag = np.array([t for _, tags in chains for t in tags], dtype=np.int64)
    lengths = np.array([len(words) for words, _ in chains], dtype=np.int64)
    features = model.features
    features[""] = 0  # the feature that is not there; its weights stay 0
    fixed, grams, sizes = _keys(list(types), model.lexicon)
    fixed, grams = (np.array([features.setdefault(k, len(features)) for k in keys]) for keys in (fixed, grams))
    fixed = fixed.reshape(-1, FIXED)
    owner = np.concatenate([np.repeat(np.arange(len(types)), FIXED), np.repeat(np.arange(len(types)), sizes)])
    feature = np.concatenate([fixed.ravel(), grams])
    value = np.concatenate([np.ones(fixed.size), np.repeat(GRAM_VALUE / sizes, sizes)])
    size = len(langs)
    onehot = np.eye(size)[tag]
    follows = np.ones(len(tag), dtype=bool)
    follows[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((size, size))
    np.add.at(seen, (tag[np.flatnonzero(follows) - 1], tag[follows]), 1.0)

    parameters = [np.zeros((len(model.features), size)), np.zeros((size, size))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for step in range(1, rounds + 1):
        weights, transitions = parameters
        potential = _potentials(weights, fixed, grams, sizes)[token]
        potential -= potential.max(axis=1, keepdims=True)
        padded, time, chain = _pad(lengths, np.exp(potential))
        marginal, expected = forward_backward(padded, lengths, np.exp(transitions), pairs=True)
        error = marginal[time, :, chain] - onehot
        by_type = np.stack([np.bincount(token, error[:, k], len(types)) for k in range(size)], axis=1)
        gradient = np.stack([np.bincount(feature, by_type[owner, k] * value, len(weights))
                             for k in range(size)], axis=1)
        gradient[0] = 0.0
        for p, g, m in zip(parameters, (gradient, expected - seen), moments):
            g = g / len(token) + DECAY * p / 10
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= RATE * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    model.weights, model.transitions = (p.astype(np.float32) for p in parameters)
    model.supports = _supports(samples, number, counts)
    return model


def _supports(samples: list[tuple[str, list[str]]], number: dict[str, int], counts: Counter) -> np.ndarray:
    """Least support per language: of each stretch the share of words that the others alone put into the lexicon."""
    shares: list[list[float]] = [[] for _ in number]
    for lang, words in samples:
        if len(words) >= CHAIN // 2:
            own = Counter(words)
            known = sum(n for w, n in own.items() if counts[w, number[lang]] - n >= 3)
            shares[number[lang]].append(known / len(words))
    return np.array([SUPPORT_SHARE * np.quantile(s, 0.01) if len(s) >= SUPPORT_STRETCHES else 0.0 for s in shares])


class Tagger:
    """The model inside one worker, with the potentials of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.transition = np.exp(model.transitions - model.transitions.max())
        self.words = WordRows(self._rows)

    def _rows(self, words: list[str]) -> np.ndarray:
        """exp(potential) per label, zeros for words without letters; then 1 per label whose lexicon holds the word."""
        size = len(self.model.langs)
        rows = np.zeros((len(words), 2 * size), dtype=np.float32)
        core = [letters(w) for w in words]
        real = np.array([i for i, w in enumerate(core) if w], dtype=np.int64)
        if len(real):
            number = self.model.features.get
            fixed, grams, sizes = _keys([core[i] for i in real], self.model.lexicon)
            fixed, grams = (np.array([number(k, 0) for k in keys]) for keys in (fixed, grams))
            potential = _potentials(self.model.weights, fixed.reshape(-1, FIXED), grams, sizes)
            potential -= potential.max(axis=1, keepdims=True)
            rows[real, :size] = np.exp(np.maximum(potential, -30.0))
            seen = [self.model.lexicon.get(core[i], 0) for i in real]
            for k in range(size):
                rows[real, size + k] = [entry >> k & 1 for entry in seen]
        return rows

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Mean label probabilities of each text; zeros for a text without words."""
        return self.measures(texts)[0]

    def measures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean label probabilities of each text, the part of them from words in the label's lexicon, and its words."""
        total = np.zeros((len(texts), 2 * len(self.model.langs)))
        count = np.zeros(len(texts))
        held, owners = [], []
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            for lo in range(0, len(words), PASS_WORDS):
                part = words[lo:lo + PASS_WORDS]
                held += part
                owners.append((i, len(part)))
                if len(held) >= PASS_WORDS:
                    self._add(held, owners, total, count)
                    held, owners = [], []
        if held:
            self._add(held, owners, total, count)
        mean, support = np.split(total / np.maximum(count, 1)[:, None], 2, axis=1)
        return mean, support, count

    def _add(self, words: list[str], owners: list[tuple[int, int]], total: np.ndarray, count: np.ndarray) -> None:
        rows, _ = self.words.lookup(words)
        doc = np.repeat(*np.array(owners, dtype=np.int64).T)
        size = len(self.model.langs)
        real = rows[:, :size].any(axis=1)
        rows, seen, doc = rows[real, :size], rows[real, size:], doc[real]
        if not len(rows):
            return
        texts, sizes = np.unique(doc, return_counts=True)
        count[texts] += sizes
        lengths = np.concatenate([[CHAIN] * (n // CHAIN) + [n % CHAIN] * (n % CHAIN > 0) for n in sizes.tolist()]).astype(np.int64)
        padded, time, chain = _pad(lengths, rows)
        marginal = forward_backward(padded, np.sort(lengths)[::-1], self.transition)
        for k in range(size):
            share = marginal[time, k, chain]
            total[:, k] += np.bincount(doc, share, len(total))
            total[:, size + k] += np.bincount(doc, share * seen[:, k], len(total))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """Learn from text and non-null language of rows whose crc32(id as text) mod 3 is not 1.

    The sample holds about ``docs_per_lang`` documents of each language, chosen by
    a hash, and STRETCHES_PER_DOC stretches of each: that much reaches the driver.
    """
    rows = pick(df, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where((crc_remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = balanced_sample(rows, "lang", [F.col("doc_id")], docs_per_lang, salt=3)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for lang, text in zip(batch["lang"], batch["text"]):
                words = [w for w in map(letters, text.lower().split()) if w]
                found += [(str(lang), w) for w in stretches(words, CHAIN, STRETCHES_PER_DOC)]
            yield pd.DataFrame(found, columns=["lang", "words"], dtype=object)
    sample = chosen.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return train([(r["lang"], list(r["words"])) for r in sample.mapInPandas(cut, "lang string, words array<string>").collect()])


def predict_column(model: Model | None, df: DataFrame, text: Column) -> Column:
    """struct(lang_pred, score, sure) of each text; sure is whether it reads as a text in that language."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, sure boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        learned = shared.value
        for batch in batches:
            if learned is None:
                yield pd.DataFrame({"lang_pred": np.full(len(batch), UNDETERMINED, dtype=object), "score": 0.0,
                                    "sure": False})
                continue
            means, support, words = worker_state(learned.key, lambda: Tagger(learned)).measures(list(batch))
            best = means.argmax(axis=1)
            top = np.clip(means.max(axis=1), 0.0, 1.0)
            names = [learned.langs[b] if s > 0 else UNDETERMINED for b, s in zip(best, top)]
            chance = 1.0 / len(learned.langs)
            sure = (words < JUDGED_WORDS) | ((top - chance >= MARGIN * (1 - chance) - 1e-6)
                                             & (support[np.arange(len(best)), best] >= learned.supports[best]))
            yield pd.DataFrame({"lang_pred": np.array(names, dtype=object), "score": top, "sure": sure & (top > 0)})
    return predict(text)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null texts and texts without letters are ``und`` with score 0, as is every text
    when there is nothing to learn from. A null id is not held out and not learned
    from. Equal means go to the language first by name. Repeated rows each return a
    row; an empty table gives an empty result.
    """
    model = fit(df, id_col, text_col, lang_col, docs_per_lang)
    rows = pick(df, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", predict_column(model, df, F.col("text").cast("string")).alias("p"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                       F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least: float = 0.25) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language is found with a score of at least ``least``.

    Texts of JUDGED_WORDS words or more must also score MARGIN above chance, however many
    languages were learned, and hold enough words of the language's lexicon: evenly mixed
    text lacks the first, letter junk and texts in no learned language the second.
    """
    model = fit(df, id_col, text_col, lang_col)
    flat = by_place(df).withColumn("_p", predict_column(model, df, place(df, text_col).cast("string")))
    kept = flat.where((F.col("_p.lang_pred") != UNDETERMINED) & (F.col("_p.score") >= least) & F.col("_p.sure"))
    return kept.drop("_p").toDF(*df.columns)
