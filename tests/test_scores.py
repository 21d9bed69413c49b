import random

import pytest
from plain import bleu, chrf, ngram_counts
from pyspark.sql import functions as F

from corpus_spark.functions import ngrams
from corpus_spark.operators import score
from corpus_spark.plans import tables

SENTENCES = [
    "the king wrote to the merchants .", "Silver, 5.5 minas (of it)!", "a", "", "é á ñ", "the the the the the", "x-y 3-4 &amp; \"q\"",
]


def make_pairs(seed, count):
    pick = random.Random(seed)
    words = " ".join(SENTENCES).split()
    pairs = []
    for _ in range(count):
        ref = [pick.choice(words) for _ in range(pick.randint(0, 14))]
        hyp = [word if pick.random() < 0.7 else pick.choice(words) for word in ref if pick.random() < 0.95]
        pairs.append((" ".join(hyp), " ".join(ref)))
    return pairs


def scored(spark, pairs, *by):
    rows = spark.createDataFrame(pairs, "prediction string, reference string" + "".join(f", {name} string" for name in by))
    return rows.repartition(3)


def one(spark, pairs):
    return score.evaluate(scored(spark, pairs)).collect()[0]


@pytest.mark.parametrize("seed", range(4))
def test_scores_match_plain(spark, seed):
    pairs = make_pairs(seed, 60)
    found = one(spark, pairs)
    assert found.bleu == pytest.approx(bleu(pairs), abs=1e-9)
    assert found.chrfpp == pytest.approx(chrf(pairs), abs=1e-9)
    assert found.geomean == pytest.approx((found.bleu * found.chrfpp) ** 0.5, abs=1e-9)


@pytest.mark.parametrize(
    "hyp, ref",
    [
        ("one two three four", "one two three five"),
        ("one two three four five", "one two six seven four five"),
        ("short text here now", "short text here now and then some more"),
        ("a b c d", "a"),
        ("a", "a b c d"),
        ("one two three four", ""),
        ("", "one two three four"),
        ("", ""),
    ],
)
def test_small_cases_match_plain(spark, hyp, ref):
    found = one(spark, [(hyp, ref)])
    assert found.bleu == pytest.approx(bleu([(hyp, ref)]), abs=1e-9)
    assert found.chrfpp == pytest.approx(chrf([(hyp, ref)]), abs=1e-9)


def test_known_values(spark):
    same = one(spark, [("one two three four five", "one two three four five")])
    assert (round(same.bleu, 9), round(same.chrfpp, 9), round(same.geomean, 9)) == (100, 100, 100)
    assert tuple(one(spark, [("aaa bbb ccc ddd", "xyz uvw")])) == (0, 0, 0)
    assert tuple(one(spark, [(None, None)])) == (0, 0, 0)
    no_rows = score.evaluate(spark.createDataFrame([], "prediction string, reference string")).collect()[0]
    assert tuple(no_rows) == (0, 0, 0)


@pytest.mark.parametrize(
    "bleu_value, chrf_value, expected",
    [(0.03, 6.56, 0.42), (29.53, 51.27, 38.91), (12.75, 33.02, 20.52), (27.99, 49.42, 37.20), (19.19, 40.29, 27.81), (0, 50, 0)],
)
def test_published_geometric_means(spark, bleu_value, chrf_value, expected):
    value = spark.range(1).select(score.geometric_mean(F.lit(float(bleu_value)), F.lit(float(chrf_value)))).collect()[0][0]
    assert value == pytest.approx(expected, abs=0.05)


def test_clean_prediction_is_preferred(spark):
    rows = spark.createDataFrame([("bad", "one two three four", "one two three four")], "prediction string, prediction_clean string, reference string")
    assert score.evaluate(rows).collect()[0].bleu == pytest.approx(100)
    with pytest.raises(ValueError, match="reference"):
        score.evaluate(rows.drop("reference"))


def test_groups_are_scored_apart_and_a_hot_group_is_whole(spark):
    pairs = make_pairs(9, 400)
    labelled = [(*pair, "hot" if place % 3 else f"g{place % 7}") for place, pair in enumerate(pairs)]
    found = {row.g: row for row in score.evaluate(scored(spark, labelled, "g"), "g").collect()}
    for group in {row[2] for row in labelled}:
        part = [row[:2] for row in labelled if row[2] == group]
        assert found[group].bleu == pytest.approx(bleu(part), abs=1e-9)
        assert found[group].chrfpp == pytest.approx(chrf(part), abs=1e-9)


def test_scoring_does_not_shuffle_rows(spark):
    rows = spark.range(4).selectExpr("'a' AS prediction", "'b' AS reference", "id % 2 AS g")
    text = score.evaluate(rows, "g")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert text.count("Exchange") == 1


def test_counts_over_chunk_borders(spark, monkeypatch):
    """Rows in small chunks count as rows in one."""
    import numpy as np
    import pyarrow as pa

    pick = random.Random(5)
    hyp = ["".join(pick.choice("aéb\U0001f600 ") for _ in range(pick.randint(0, 50))) for _ in range(80)]
    ref = ["".join(pick.choice("aéb\U0001f600 ") for _ in range(pick.randint(0, 50))) for _ in range(80)]
    expected = [[value for order in range(1, 7) for value in ngram_counts(h, r, order)] for h, r in zip(hyp, ref)]
    for size, bits in ((1, 63), (64, 63), (1 << 20, 63), (1 << 20, 20), (1 << 20, 14), (1 << 20, 8)):
        monkeypatch.setattr(ngrams, "_CHUNK_BYTES", size)
        monkeypatch.setattr(ngrams, "_KEY_BITS", bits)
        parts = [ngrams._char_counts(*chunk, 6) for chunk in ngrams._chunks(pa.array(hyp), pa.array(ref))]
        assert np.concatenate(parts).reshape(80, -1).tolist() == expected
    words = [" ".join(text.split()) for text in hyp], [" ".join(text.split()) for text in ref]
    expected = [[value for order in range(1, 5) for value in ngram_counts(h.split(), r.split(), order)] for h, r in zip(*words)]
    for bits in (63, 16, 9):
        monkeypatch.setattr(ngrams, "_KEY_BITS", bits)
        assert ngrams._word_counts(pa.array(words[0]), pa.array(words[1]), 4).reshape(80, -1).tolist() == expected


def test_driver_pairs_match_plain(spark, small_dir):
    rows = tables.predictions(spark, small_dir)
    pairs = [(row.prediction, row.reference) for row in rows.collect()]
    found = score.evaluate(rows).collect()[0]
    assert found.bleu == pytest.approx(bleu(pairs), abs=1e-9)
    assert found.chrfpp == pytest.approx(chrf(pairs), abs=1e-9)


def test_last_epoch(spark):
    rows = spark.createDataFrame(
        [("a", 1, 9.0, 9.0, 9.0), ("a", 3, 1.0, 2.0, 3.0), ("b", 2, 4.0, 5.0, 6.0)],
        "run string, epoch int, bleu double, chrfpp double, geomean double",
    )
    assert sorted(map(tuple, score.last_epoch_scores(rows).collect())) == [("a", 1.0, 2.0, 3.0, 3), ("b", 4.0, 5.0, 6.0, 2)]
