import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import resampling as R


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(ws, lo, hi):
    return [" ".join(ws[i:i + n]) for n in range(lo, hi + 1) for i in range(len(ws) - n + 1)]


def brute(docs, items, lo, hi, buckets, seed, min_words, percent):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    feats = [[bucket(f) for f in runs(words(t), lo, hi)] for _, t in docs]
    s = Counter(b for f in feats for b in f)
    t = Counter(bucket(f) for x in items for f in runs(words(x), lo, hi))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (s_all + buckets)) / float((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for (d, text), f in zip(docs, feats):
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_composed_checksums():
    rng = random.Random(1)
    for _ in range(50):
        ws = [bytes(rng.choices(range(97, 123), k=rng.randint(1, 300))) for _ in range(rng.randint(1, 9))]
        crc, size = R.payloads(b" ".join(ws))
        assert crc.tolist() == [zlib.crc32(w) for w in ws] and size.tolist() == list(map(len, ws))
        got = R.run_crcs(crc, size, 1, 4)
        assert got.tolist() == [zlib.crc32(f.encode()) for f in runs([w.decode() for w in ws], 1, 4)]


@pytest.mark.parametrize("window", [300, 1 << 20])
@pytest.mark.parametrize("lo,hi,buckets", [(1, 1, 10_000), (1, 3, 64), (2, 2, 70_000)])
def test_against_brute_force(spark, monkeypatch, lo, hi, buckets, window):
    monkeypatch.setattr(R, "WINDOW_BYTES", window)
    rng = random.Random(7)
    vocab = ["the", "The", "é", "Éa", "x9", "ab", "a" * 300, "b" * 400, "词", "on", "THE"]

    def text(k):
        return "".join(rng.choice(vocab) + rng.choice([" ", "  ", "-", "\n", "_", "\x00"]) for _ in range(k))

    docs = [(i, text(rng.randint(0, 60))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "--- "), (None, text(30)), (103, "q" * 5_000), (104, "the " * 30_000), docs[0], docs[0], (0, "other the")]
    items = [text(12) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, score long, buckets string")
    bench = spark.createDataFrame([(t,) for t in items], "text string")
    got = R.resample(df, bench, lo, hi, buckets).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, lo, hi, buckets, R.SEED, R.MIN_WORDS, R.PERCENT)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r.rank is not None for r in got) + 1))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert R.resample(df.limit(0), df).count() == 0
    assert [tuple(r)[:2] for r in R.resample(df, df.select("text").limit(0), percent=100).collect()] == [(1, 60)]


def test_hot_score_is_split(spark):
    """A third of all rows equal in score, id and text: ranks are gapless and no rank is given twice."""
    rows = [(None, "w " * 25)] * 400 + [(i, f"w{i} " * 25) for i in range(800)]
    got = R.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(6),
                     spark.createDataFrame([("w",)], "text string"), percent=60).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 721)) and len(got) == 1200
    assert np.array([r.score for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)]).tolist() == \
        sorted((r.score for r in got), reverse=True)[:720]
