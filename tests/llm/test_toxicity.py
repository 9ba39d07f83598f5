import itertools

import numpy as np

from tillroll.llm import toxicity as T
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    emit, trans = rng.normal(size=(4, 5)) * 2, rng.normal(size=(2, 2))
    mask = np.arange(5)[None, :] < np.array([5, 1, 3, 4])[:, None]
    p, pair = T.forward_backward(emit * mask, mask, trans)
    for c in range(4):
        n = int(mask[c].sum())
        want, wpair, total = np.zeros(n), np.zeros((2, 2)), 0.0
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emit[c, i] * t for i, t in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            want += w * np.array(path)
            for a, b in zip(path, path[1:]):
                wpair[a, b] += w
        assert np.allclose(p[c, :n], want / total) and not p[c, n:].any()
        assert np.allclose(pair[c], wpair / total)


def test_flat_marginals_follow_texts():
    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=200), rng.normal(size=(2, 2))
    doc = np.repeat([0, 2, 5], [70, 1, 129])
    got = T.marginals(emit, doc, trans)
    for d in (0, 2, 5):
        e = emit[doc == d]
        for i in range(0, len(e), T.CHAIN):
            part = e[i:i + T.CHAIN]
            want = T.forward_backward(part[None], np.ones((1, len(part)), bool), trans)[0][0]
            assert np.allclose(got[doc == d][i:i + T.CHAIN], want)


def test_link_settles_where_evidence_parts_almost_all():
    rng = np.random.default_rng(5)
    toxic = np.arange(6000) < 600
    odds = np.where(toxic, 3.4, -3.3) + rng.normal(0, 0.05, 6000)
    odds[-3:] = 0.5  # three clean documents between
    x = np.stack([np.ones(6000), odds, np.where(toxic, rng.uniform(0.7, 3, 6000), rng.uniform(0, 0.2, 6000))], axis=1)
    link = T.fit_link(x, toxic)
    p = 1 / (1 + np.exp(-x @ link))
    assert np.abs(link).max() < 100 and np.abs(x.T @ (p - toxic) + 0.05 * link).max() < 1e-3
    assert p[toxic].min() > 0.9 and p[~toxic].max() < 0.3


def test_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op2_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    print(len(toxic), toxic.predicted.mean(), clean.predicted.mean())
    assert toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.02
    model = T.train(docs, labels)
    rows = T.score(docs.limit(3000), model).where("n_toxic_tokens > 0").join(docs, "doc_id").collect()
    words = [r.text[s.start:s.end] for r in rows for s in r.spans]
    assert "idiot" in words and sum(r.n_toxic_tokens for r in rows) >= len(words)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (2, "", 0.1), (None, "İa b", 0.1), (4, "w " * 40_000, 0.1)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(docs, none)
    got = T.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 0.05 and r.predicted == 0 and r.spans == [] for r in got)
    assert T.score(docs.limit(0), model).count() == 0
