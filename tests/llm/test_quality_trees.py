import numpy as np
import pyarrow as pa

from tillroll.llm import quality_trees as Q
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_features_of_single_texts_equal_those_of_a_batch():
    texts = [None, "", " ", "a", "one two two\none two", "!! ** é", "x " * 3000, "\n\n", "a\nb\na"]
    whole = Q.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], Q.features(pa.array([t], pa.string()))[0]), t
    f = dict(zip(Q.FEATURES, whole[4]))
    assert np.isclose(f["distinct_words"], 0.4) and np.isclose(f["stutter"], 0.2) and np.isclose(f["top_word"], 0.6)
    assert np.isclose(f["repeated_pairs"], 0.2) and np.isclose(np.expm1(f["log_words"]), 5) and np.isclose(f["short_words"], 0)
    assert np.isclose(dict(zip(Q.FEATURES, whole[8]))["repeated_lines"], 1 / 3)
    assert not whole[0].any() and Q.features(pa.array(texts).slice(3, 2)).tolist() == whole[3:5].tolist()


def walk(f, t, row):
    i = 0
    while i < f.feature.shape[1]:
        i = 2 * i + 1 + int(row[f.feature[t, i]] > f.threshold[t, i])
    return f.leaf[t, i - f.feature.shape[1]]


def test_flat_trees_equal_walked_trees_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    f = Q.fit(x[:1000], y[:1000], trees=30)
    s = f.score(x)
    z = [f.base + sum(walk(f, t, r) for t in range(30)) for r in x[:50]]
    assert np.allclose(s[:50], 1 / (1 + np.exp(-np.array(z))))
    assert ((s >= 0.5) == y)[1000:].mean() > 0.95
    assert Q.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert Q.fit(x[:9], np.ones(9)).score(x[:2]).min() > 0.9


def test_held_out_accuracy(spark):
    got = QUERIES["op6_quality_trees"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 1000
    assert (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 0].predicted.mean() < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3), (4, "w " * 40_000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels.limit(0))).count() == 0
