"""The passage model: exact gradients, whole texts, held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import passage_quality as Q
from tessella.llm.queries import op12_passage_quality

DOCS = "doc_id bigint, text string, quality int, n int, good_label string, t string"
PLAIN = [f"The {w} of the river is a quiet place, and we came to it by boat." for w in ("house", "town", "garden", "bridge", "mill", "road", "hill")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 1, "x", "y") for i, t in rows], DOCS)


def test_gradients_are_those_of_the_loss():
    texts = ["one two three " * 50, "", "FOUR $$$ five!", None, "six " * 129]
    good, weights = np.array([1, 0, 0, 1, 1]), np.array([0.3, 0.1, 0.2, 0.2, 0.2])
    bag, model = Q.bags(texts), Q.Model(words=Q._seeded(1 << Q.BITS, Q.WIDTH, 0.3, 9))
    for name in ("words", *Q.Model.DENSE):
        setattr(model, name, getattr(model, name).astype(np.float64))
    dense, rows, words = Q.gradients(model, bag, good, weights)
    loss = lambda: Q._loss(model.logits(bag)[0].astype(float), good, weights) * weights.sum()

    def slope(array, at, e=1e-4):
        held = array[at]
        array[at] = held + e
        up = loss()
        array[at] = held - e
        down = loss()
        array[at] = held
        return (up - down) / (2 * e)

    for name, gradient in dense.items():
        for at in ((0, 0), tuple(x - 1 for x in gradient.shape)):
            assert slope(getattr(model, name), at) == pytest.approx(gradient[at], rel=0.02, abs=2e-5), name
    for at in (0, len(rows) - 1):
        assert slope(model.words, (rows[at], 3)) == pytest.approx(words[at, 3], rel=0.02, abs=2e-5)


def test_passages_cover_whole_texts():
    bag = Q.bags(["a " * 129, None, "", "b", " \n\x0b "])
    assert list(np.diff(bag.first)) == [3, 1, 1, 1, 1] and list(np.diff(bag.starts)) == [64, 64, 1, 0, 0, 1, 0]
    assert len(bag.ids) == 130 and len(bag.rows) == 2
    assert list(np.diff(Q._select(bag, np.array([3, 0])).starts)) == [1, 64, 64, 1]


def test_attention_is_a_share_and_texts_do_not_mix():
    texts = [" ".join(PLAIN * 20), "", "$$$ ### " * 500, None]
    model = Q.fit([*PLAIN * 5, *["$$$ ### |||"] * 35], np.array([1] * 35 + [0] * 35), 0.5)
    together, attention = model.scores(Q.bags(texts))
    assert np.add.reduceat(attention, Q.bags(texts).first[:-1]) == pytest.approx(np.ones(4), abs=1e-5)
    alone = [model.scores(Q.bags([t]))[0][0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5) and together[0] > 0.7 > 0.3 > together[2]


def test_the_end_of_a_long_text_counts():
    """Labels of documents only: one bad passage among good ones is found, wherever it stands."""
    bad = "$%& ||| ### @@@ " * 16
    long = [" ".join(PLAIN * 4), " ".join(PLAIN * 4) + " " + bad]
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(200):
        parts = [str(p) for p in rng.permutation(PLAIN * 4)]
        if i % 2:
            parts.insert(int(rng.integers(len(parts))), bad)
        texts.append(" ".join(parts))
        labels.append(1 - i % 2)
    scores, attention = Q.fit(texts, np.array(labels), 0.5).scores(Q.bags(long))
    assert scores[0] > 0.7 > 0.5 > scores[1]


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 60_000), (5, PLAIN[0]), (5, PLAIN[0]), (None, PLAIN[1]), (7, "é日本 " * 300)]
    docs = frame(spark, [*rows, *[(100 + i, PLAIN[i % 7]) for i in range(60)], *[(200 + i, "$$$ | ### " * 9) for i in range(60)]])
    labels = spark.createDataFrame(
        [*[(100 + i, 1) for i in range(60)], *[(200 + i, 0) for i in range(60)], (100, None), (None, 1), (5, 1), (5, 0), (999, 1)], "doc_id bigint, quality int"
    )
    model = Q.learn(docs, labels, F.col("doc_id") != 3)
    got = Q.score(docs, model)
    assert got.columns == ["doc_id", "quality", "n", "good_label", "t", "score", "predicted", "n_passages", "top_passage"]
    found = got.collect()
    assert len(found) == 128 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((round(r.score, 6), r.n_passages))
    assert all(len(x) == 1 for x in by.values())
    assert by[1] == by[2] == by[3] and min(by[100])[0] > 0.7 > max(by[200])[0] and min(by[4])[1] == 938


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for model in (Q.learn(docs, labels, F.lit(True)), Q.learn(docs, labels.limit(0), F.lit(True)), Q.learn(docs.limit(0), labels, F.lit(True))):
        assert [(r.score, r.predicted) for r in Q.score(docs, model).collect()] == [(0.5, 0)] * 2
    assert Q.score(docs.limit(0), None).collect() == []


def test_names_that_are_taken(spark):
    docs = frame(spark, [(1, "a")]).withColumn("Score", F.lit("mine"))
    with pytest.raises(ValueError, match="score"):
        Q.score(docs, None)
    got = Q.score(docs, None, into=("s", "p", "k", "b")).first()
    assert (got["Score"], got.s, got.p, got.k) == ("mine", 0.5, 0, 1)


def test_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = op12_passage_quality(spark, folder)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(got.columns)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
