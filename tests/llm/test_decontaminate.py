import hashlib
import random
import re

import pytest

from tillroll.llm import decontaminate as D
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for k, t in items:
        ws = tokens(t)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wins.setdefault(tuple(ws[i:i + window]), set()).add(k)
    out = []
    for d, t in docs:
        ws = tokens(t)
        hit, found = set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(ws[i:i + n])]
        names = sorted(map(str, found))
        out.append((d, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op7_decontaminate"](spark, SF).select(COLS).collect()), key=str)
    assert got == brute(docs, items) and any(r[-1] for r in got)


@pytest.mark.parametrize("block_words", [25, 10**6])
def test_edges_and_blocks(spark, block_words):
    rng = random.Random(5)
    vocab = ["a", "b", "é", "Z9", "the"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 14)))) for i in range(30)] + [(50, None), (51, ""), (52, "--"), (2, "a b a b")]
    items += [(60, items[3][1])]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60))) + "!") for i in range(60)]
    docs += [(70, None), (71, ""), (1, "THE the"), (None, items[0][1]), (72, items[1][1] + " x " + items[1][1]), (72, "a"), (73, "q " * 30_000 + items[2][1]),
             docs[0], docs[0]]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.report(D.decontaminate(df, bench, block_words=block_words)).select(COLS).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    assert D.report(D.decontaminate(df.limit(0), bench)).count() == 0
    none = D.report(D.decontaminate(df, bench.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta the of and to in is")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "delta x gamma y beta z alpha"), (2, "alpha " + "x " * 40 + "beta gamma delta"),
                                  *((i, "the of and to in is " * 9) for i in range(3, 9))], "doc_id long, text string")
    got = {r.doc_id: r for r in D.report(D.decontaminate(docs, items)).collect()}
    assert [got[i].n_near_items for i in (1, 2, 3)] == [1, 0, 0] and not any(r.contaminated for r in got.values())
