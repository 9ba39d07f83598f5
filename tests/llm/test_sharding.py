import zlib
from collections import Counter, defaultdict

import pytest

from tillroll.llm import sharding as S
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def check(docs, got, shards=8):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query_keeps_copies_together(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_label_shards"](spark, SF).collect()
    check(docs, got)
    copies, where = Counter(t for _, t in docs), defaultdict(Counter)
    text = dict(docs)
    for r in got:
        if copies[text[r.doc_id]] > 1:
            where[text[r.doc_id]][r.shard] += 1
    linked = sum(sum(c.values()) for c in where.values())
    cut = sum(sum(c.values()) - max(c.values()) for c in where.values())
    assert linked > 50 and cut <= 0.15 * linked  # a hash alone cuts about half of them


@pytest.mark.parametrize("shards", [3, 8])
def test_hot_group_and_edges(spark, shards, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    docs = [(i, "hot") for i in range(200)] + [(i, f"t{i}") for i in range(200, 500)] + [(i, f"pair{i // 2}") for i in range(500, 600)]
    docs += [(None, None), (None, None), (1, ""), (1, ""), (2, "é"), docs[0], (7, "long " * 50_000)]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, shard int")
    check(docs, S.shard_documents(df, shards).collect(), shards)
    assert S.shard_documents(df.limit(0)).count() == 0
