import random
import re
import time

import numpy as np
import pytest

from tillroll.llm import common
from tillroll.llm import jaccard_join as J
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 85 * (len(a) + len(b) - n):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))], key=str)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op9_jaccard_join"](spark, SF).collect()), key=str)
    assert got == brute(docs) and len({r[2] for r in got}) < len(docs)


def test_every_linked_pair_shares_a_cell():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.random() * 0.16]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common) and len(a) + len(b) != 2 * common:
            assert set(J.cells(a).tolist()) & set(J.cells(b).tolist()), (len(a), len(b), common)


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random()], rng.integers(0, 2**63, 40).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        bits = int(np.bitwise_count((J.sketch(a) ^ J.sketch(b)).view(np.uint64)).sum())
        assert bits <= differ and (differ > 200 or bits * 2 > differ)


@pytest.mark.parametrize("pivots", [1, 8])
def test_chains_shells_and_edges(spark, monkeypatch, pivots):
    monkeypatch.setattr(J, "PIVOTS", pivots)
    rng = random.Random(pivots)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for family in range(4):  # families whose members drift apart, so that links form chains
        now = [f"{w}f{family}" if rng.random() < 0.5 else w for w in base]
        for _ in range(14):
            docs.append((rng.randint(1, 10_000), " ".join(now)))
            now = list(now)
            for _ in range(rng.choice([1, 1, 2, 4])):
                now[rng.randrange(len(now))] = f"n{rng.random()}"
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(20_000 + i, passage + " " + " ".join(f"q{i}x{k}" for k in range(8 + i % 5))) for i in range(25)]
    docs += [(30_000, "Same Words under one id " + passage), (30_000, "same words  under ONE id " + passage), (30_001, "same words under one id " + passage + " z")]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (5, "A b"), (None, "a b"), (6, "one two three four"), (7, "x " * 30_000),
             (8, "x " * 20_000), docs[0], (docs[1][0], "different text under the same number")]
    df = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, node string")
    assert sorted(map(tuple, J.near_classes(df).collect()), key=str) == brute(docs)


def test_sets_without_a_common_shingle_share_no_cell():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(400, 440, 200)]
        counted = np.unique(np.concatenate([np.unique(J.cells(s, percent)) for s in sets]), return_counts=True)[1]
        assert (counted > 1).sum() <= 5, percent


@pytest.mark.parametrize("percent", [80, 85])
def test_first_parts_of_linked_sets_meet(percent):
    rng = np.random.default_rng(percent)
    for _ in range(2000):  # as far apart as a link allows, from the least sizes up
        n = int(rng.integers(2, 60 if rng.random() < 0.7 else 700))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        differ = int(rng.integers(1, 2 * n * (100 - percent) // (100 + percent) + 2))
        less = int(rng.integers(0, differ + 1))
        b = np.unique(np.concatenate([a[less:], rng.integers(0, 2**63, differ - less).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common) and len(a) + len(b) != 2 * common:
            assert set(J.cells(a, percent).tolist()) & set(J.cells(b, percent).tolist()), (len(a), len(b), common)


def test_a_common_passage_puts_few_sets_together():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**63, int(rng.integers(400, 500))).astype(np.uint64)])) for _ in range(200)]
    for percent in (80, 85):
        numbers = [np.unique(J.cells(s, percent)) for s in sets]
        counted = dict(zip(*np.unique(np.concatenate(numbers), return_counts=True)))
        assert sum(any(counted[c] > 1 for c in x) for x in numbers) < 60, percent


def test_pivots_are_counted_off_not_joined_off(spark, monkeypatch):
    monkeypatch.setattr(J, "PIVOTS", 1)
    plans, store = [], J.store

    def spied(df, name):
        if name == "open-cells":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(J, "store", spied)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(100))
    docs = [(i, passage + " " + " ".join(f"q{rng.random()}" for _ in range(24))) for i in range(12)]
    assert sorted(map(tuple, J.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str) == brute(docs)
    assert len(plans) > 1 and not any("LeftAnti" in p for p in plans)


def test_split_keeps_every_row_once(spark):
    rows = spark.range(2000).selectExpr("if(id % 9 = 0, null, id) as k", "concat('t', id) as text").repartition(4)
    rows = rows.unionByName(rows.where("k % 7 = 0"))
    for wanted in (rows.where("k % 50 = 0").select("k"), rows.limit(0).select("k")):
        some, others = J.split(rows, "k", wanted)
        assert some.columns == others.columns == rows.columns
        assert sorted(map(str, some.unionByName(others).collect())) == sorted(map(str, rows.collect()))
        assert others.join(wanted, "k", "left_semi").count() == 0 and some.count() <= wanted.count() + 20


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"/(shuffle_\d+_\d+)_", found))

    kept, before = spark.conf.get(common.CLEANUP, None), files()
    stored = common.store(spark.range(5000).repartition("id").groupBy("id").count(), "counts")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP, None) == kept and stored.count() == 5000


def test_distances_of_blocks_that_are_split(spark, monkeypatch):
    monkeypatch.setattr(J, "LEADS", 3)
    monkeypatch.setattr(J, "FOLLOWERS", 4)
    rng = random.Random(5)
    texts = {i: " ".join(f"w{k}" if rng.random() < 0.9 else f"n{rng.random()}" for k in range(60)) for i in range(30)}
    whole = spark.createDataFrame([*texts.items(), (4, texts[4].upper())], "node long, text string")
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.5]
    got = J.distances(whole, spark.createDataFrame(pairs, "a long, b long"), 4, 85).collect()
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in pairs}
    assert len(got) == len(pairs) and {(r["a"], r["b"]) for r in got} == set(want)
    for r in got:
        common, union = want[r["a"], r["b"]]
        assert abs(r["distance"] - (1 - common / union)) < 1e-12 and r["linked"] == (100 * common >= 85 * union)


def test_rounds_grow_with_the_logarithm_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(J, "PIVOTS", 1)
    stored, store = [], J.store
    monkeypatch.setattr(J, "store", lambda df, name: stored.append(name) or store(df, name))
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(100))
    docs = [(i, passage + " " + " ".join(f"q{rng.random()}" for _ in range(24))) for i in range(40)]
    assert sorted(map(tuple, J.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str) == brute(docs)
    assert 2 < stored.count("open-cells") <= 6


def test_only_likely_texts_move(spark):
    for kind in ("long", "string"):
        rows = spark.range(-1000, 20_000).selectExpr(f"cast(id as {kind}) as doc_id", "concat('t', id) as text")
        rows = rows.unionByName(rows.where("doc_id % 7 = 0")).unionByName(spark.sql(f"SELECT cast(null as {kind}) AS doc_id, 'x' AS text"))
        wanted = rows.where("doc_id % 50 = 0").select("doc_id")
        got = J.likely(rows, "doc_id", wanted)
        need = sorted(map(tuple, rows.where("doc_id % 50 = 0").collect()))
        assert got.columns == rows.columns and sorted(map(tuple, got.where("doc_id % 50 = 0").collect())) == need
        assert got.count() < len(need) + 50 and J.likely(rows, "doc_id", wanted.limit(0)).count() == 0


def test_empty(spark):
    assert J.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
