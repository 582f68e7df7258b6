"""Counts behind a hash prefilter against plain counts of every term."""

import collections
import random

import pytest

from newsprism.operators import terms as tm


def exact(rows, min_df, most):
    docs, total = collections.Counter(), collections.Counter()
    for terms in rows:
        docs.update(set(terms or []))
        total.update(terms or [])
    chosen = sorted((t for t in total if docs[t] >= min_df), key=lambda t: (-total[t], t))[:most]
    return {(t, i, docs[t], total[t]) for i, t in enumerate(sorted(chosen))}


def texts():
    draw = random.Random(3)
    words = [f"w{int(draw.paretovariate(0.6)) % 900}" for _ in range(6000)]
    rows = [words[i:i + 40] for i in range(0, 6000, 40)]
    rows += [["twice", "twice"], ["only here"] * 500, ["tie a", "tie b"], ["tie a", "tie b"], [], None]
    return rows + [["hot"] * 300 for _ in range(60)]


@pytest.mark.parametrize("cells", [1, 7, 300, tm.CELLS])
def test_vocabulary_equals_that_of_all_terms(spark, cells):
    rows = texts()
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>").repartition(5)
    for min_df, most in ((2, 20), (2, 1), (3, 5000), (1, None), (2, None)):
        got = tm.vocabulary_of(tm.heavy_stats(df, "t", min_df, most, cells), min_df, most).collect()
        assert set(map(tuple, got)) == exact(rows, min_df, most), (cells, min_df, most)


def test_a_wrong_guess_takes_the_second_pass(spark):
    """Two terms of one document each fill their cells; the guess from the cells lies above what enough terms reach."""
    rows = [["big"] * 1000, ["large"] * 900, *[[f"p{i}", f"q{i}"] for i in range(30)], *[[f"p{i}"] for i in range(30)]]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    for cells in (2, 13, 64):
        got = tm.vocabulary_of(tm.heavy_stats(df, "t", 2, 10, cells), 2, 10).collect()
        assert set(map(tuple, got)) == exact(rows, 2, 10)


def test_rare_terms_are_not_shuffled(spark):
    rows = [[f"common{i % 20}" for i in range(40)] + [f"once{d}x{i}" for i in range(30)] for d in range(50)]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    counted = tm.heavy_stats(df, "t", 1, 10)
    assert counted.count() < 60  # of 1,520 terms
    assert set(map(tuple, tm.vocabulary_of(counted, 1, 10).collect())) == exact(rows, 1, 10)


def test_no_rows_give_no_terms(spark):
    for rows in ([], [(None,)], [([],)]):
        df = spark.createDataFrame(rows, "t array<string>")
        assert tm.vocabulary_of(tm.heavy_stats(df, "t")).collect() == []


@pytest.mark.parametrize("cells", [13, tm.CELLS])
def test_vocabularies_without_a_fold_equal_those_of_all_terms(spark, cells):
    """Counts without each fold hold every term of the vocabularies, also where the guess from the cells is too high."""
    rows = texts() + [["big"] * 1000, ["large"] * 900, ["one fold", "one fold"]] * 2
    df = spark.createDataFrame([(i * 7 % 4, r) for i, r in enumerate(rows)], "fold int, t array<string>").repartition(5)
    choices = [(2, 20), (3, 5000), (1, 3)]
    for chosen in (choices[2:], choices):
        stats = tm.left_out_stats(df, "t", "fold", 4, chosen, cells)
        for min_df, most in chosen:
            got = {}
            for r in tm.vocabulary_cells(stats, 5, min_df).collect():
                got.setdefault(r["cell"], []).append((-r["total_count"], r["term"], r["doc_freq"]))
            for f in range(5):
                kept = exact([r for i, r in enumerate(rows) if i * 7 % 4 != f], min_df, most)
                assert {(t, d, -n) for n, t, d in sorted(got[f])[:most]} == {(t, d, n) for t, _, d, n in kept}, (cells, f)
