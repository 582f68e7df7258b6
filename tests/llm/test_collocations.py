"""Collocations against brute force, with prefixes over and under the budget."""

import collections
import random
import re

import numpy as np
import pytest
from llm_rows import DOCS

from newsprism.llm import collocations, queries

SF = "/root/testdata/sf0.001"


def brute(rows, least=30, top=2000, covered=80):
    """rows: (lang, text); result rows (lang, rank, phrase, a, l, r, n, score)."""
    count, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i:i + size])] += 1
    found = {p: f for p, f in count.items() if len(p[1]) > 1 and f >= least}
    cover = collections.Counter()
    for (lang, words), f in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = lang, words[i:i + size]
                cover[key] = max(cover[key], f)
    by_lang = collections.defaultdict(list)
    for (lang, words), a in found.items():
        if 100 * cover[lang, words] >= covered * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        phrase = " ".join(words)
        by_lang[lang].append((-score, -a, phrase.encode(), phrase, left, right))
    return sorted((lang, rank, phrase, -a, left, right, n[lang], -s) for lang, every in by_lang.items()
                  for rank, (s, a, _, phrase, left, right) in enumerate(sorted(every)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_words_and_pieces():
    text = "A b,c\td  É\x0be\x85f\u2028g\u00a0h \x1c x"
    want = []
    for piece in re.split("[.,;:!?\x0A-\x0D]", text.replace("A", "a")):
        want += [w.encode() for w in re.findall("[^\x20\x09]+", piece)] + [b"."]
    assert collocations.tokens([text]) == want[:-1]
    assert collocations.tokens(["a b", "c"]) == [b"a", b"b", b".", b"c"]


def test_whole_table(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got(queries.op13_collocations(spark, SF))
    assert found == brute(rows) and len(found) > 20


def corpus(seed, n=400):
    """Few words, so that single words, pairs and triples exceed a small budget."""
    draw = random.Random(seed)
    words = ["the", "of", "a", "x", "Zed", "ü", "rare"]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(words, [30, 20, 10, 5, 5, 3, .1], k=draw.randrange(0, 60)))
        rows.append((draw.choice(["en", "en", "de", None]), text.replace("x x", "x. x").replace("a the of a", "a the of a of")))
    return rows + [("en", "new york city hall " * 50), ("en", None), ("de", ""), ("fr", "une fois " * 31 + "; puis")]


@pytest.mark.parametrize("budget,bits,held,least", [(1 << 20, 1 << 25, 1 << 20, 30), (50, 1 << 10, 300, 30), (900, 8, 1 << 20, 3),
                                                    (5000, 1 << 16, 2000, 1)])
def test_against_brute_force(spark, monkeypatch, budget, bits, held, least):
    monkeypatch.setattr(collocations, "HELD_WINDOWS", held)
    rows = corpus(budget)
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, Lang string").repartition(5)
    assert got(collocations.mine(df, budget=budget, bitmap_bits=bits, least=least)) == brute(rows, least)
    assert got(collocations.mine(df, budget=budget, bitmap_bits=bits, least=least, top=3, covered_percent=100)) == brute(rows, least, 3, 100)


def test_awkward_and_empty(awkward, empty):
    assert got(collocations.mine(awkward, least=2)) == brute([(lang, t) for _, t, lang, *_ in DOCS], 2)
    assert collocations.mine(empty).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(awkward, bitmap_bits=100)


def test_a_shared_hash_takes_another_seed(spark, monkeypatch):
    rows = [("en", "aa bb cc " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    counts = collocations.word_counts

    def clashing(docs, seed):
        out = counts(docs, seed)
        return out if seed else out.selectExpr("lang", "word", "h - h as h", "f")
    monkeypatch.setattr(collocations, "word_counts", clashing)
    assert collocations.distinct_hashes(df)[1] == 1
    assert got(collocations.mine(df)) == brute(rows)


def test_prefixes_are_confirmed_by_their_words():
    words = np.array([[7, 9]], dtype=np.uint64)
    cutter = collocations.Cutter(np.zeros(1, np.uint8), 0, [(np.array([5], np.uint64), words[:, :1]),
                                                           (collocations.mixed(words, 2), words)])
    window = np.array([[7, 9, 1, 0], [7, 8, 1, 0]], dtype=np.uint64)
    assert cutter.is_hot(window, 2).tolist() == [True, False]
