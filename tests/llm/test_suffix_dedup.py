import hashlib
import random
from collections import Counter

import pytest

from tillroll.llm import suffix_dedup as S
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i:i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        reach = 0
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[max(i, reach):i + length] = b"\1" * (i + length - max(i, reach))
                reach = i + length
        runs = sum(1 for x in bytes(gone).split(b"\0") if x)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def got(df):
    return sorted(map(tuple, df.select(COLS).collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = got(QUERIES["op12_suffix_dedup"](spark, SF))
    assert rows == brute(docs, 200) and sum(r[2] > 0 for r in rows) > 20 and sum(r[2] == 0 for r in rows) > 20


@pytest.mark.parametrize("length,gram,shard,chunk", [(20, 6, 64, 1 << 18), (20, 20, 2, 64), (13, 1, 4, 100)])
def test_edges(spark, monkeypatch, length, gram, shard, chunk):
    monkeypatch.setattr(S, "SHARD_SEGMENTS", shard)
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(9)

    def text(n, letters="abé"):
        return "".join(rng.choice(letters) for _ in range(n))

    passage = text(90, "abcdefgh")
    docs = [(i, text(rng.randint(0, 60)) + (passage[rng.randint(0, 40):rng.randint(41, 90)] if i % 2 else "") + text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 500), (103, "xy" * 300), (104, text(3_000)), (105, text(length - 1, "q")), (106, text(length - 1, "q")),
             (107, "z" * length), (108, "z" * length), (109, "é" * 100), (None, passage), docs[0], docs[0], docs[3], (110, docs[5][1]), (111, passage * 3)]
    df = spark.createDataFrame([(*d, 1, 2, "s") for d in docs], "doc_id long, text string, k1 int, g int, spans string").repartition(5)
    assert got(S.remove_repeats(df, length, gram)) == brute(docs, length)
    assert S.remove_repeats(df.limit(0), length, gram).count() == 0


def test_hot_passage(spark):
    """A passage in two thirds of the documents, each time in other surroundings; a third are one text."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    passage, copy = text(60), text(100)
    docs = [(i, text(40) + passage + text(40)) for i in range(150)] + [(200 + i, copy) for i in range(100)] + [(400 + i, text(80)) for i in range(50)]
    rows = got(S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)))
    assert rows == brute(docs, 200) and all(r[2] >= len(passage) for r in rows if r[0] < 150)
