import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillroll.llm import bitpack, packing
from tillroll.llm.common import shared_path
from tillroll.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
ENC = Encoder(PATH, cache_bytes=60_000)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t  \x1c'.,;sdtlé€漢²5aB_<|>\U0001f600"), max_size=30), max_size=4))
def test_units_give_the_ids_of_the_whole_text(texts):
    ids, sizes = ENC(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [plain(t) for t in texts]


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50), st.data())
def test_pack_round_trip_and_random_access(width, ids, data):
    ids = np.array([i & ((1 << width) - 1) for i in ids], np.uint32)
    payload = bitpack.pack(ids, width)
    assert len(payload) == (len(ids) * width + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert bitpack.unpack(payload, width, a, b - a).tolist() == ids[a:b].tolist()


DOCS = [(5, "the cat  sat.\nOn the mat"), (1, ""), (None, "x y"), (3, None), (5, "the cat"), (2, "<|endoftext|> word's"), (2, "word " * 30_000),
        (2, "word " * 30_000)]


def test_blocks_against_brute_force(spark):
    df = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, part int").repartition(4)
    path = shared_path(spark, "t")
    bitpack.write_blocks(df, path, PATH, bitpack.vocabulary_size(PATH), block_ids=100)
    got = sorted(map(tuple, bitpack.read_documents(spark.read.parquet(path)).collect()), key=lambda r: r[1])
    want = defaultdict(int)
    for d, t in DOCS:
        ids = np.array(plain(t) + [0], "<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    have = defaultdict(int)
    for d, _, n, c in got:
        have[(d, n, c)] += 1
    assert have == want
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got[:-1])]
    assert [r[0] for r in got] == [None, 1, 2, 2, 2, 3, 5, 5]
    empty = shared_path(spark, "t")
    bitpack.write_blocks(df.limit(0), empty, PATH, 50_257)
    assert bitpack.read_documents(spark.read.schema(bitpack.BLOCK_SCHEMA).parquet(empty)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lens = np.unique(rng.integers(1, 40, 9))
    counts = rng.integers(1, 20, len(lens))
    best = min(sum(c * (min(u for u in ups if u >= v) - v) for v, c in zip(lens, counts))
               for k in range(3) for rest in itertools.combinations(lens[:-1], k) for ups in [(*rest, lens[-1])])
    ups = packing.best_boundaries(lens, counts, counts * lens, 3)
    assert len(ups) <= 3 and sum(c * (min(u for u in ups if u >= v) - v) for v, c in zip(lens, counts)) == best


def test_batches(spark):
    rows = [(i, "a b " * (i % 7)) for i in range(300)] + [(900, None), (None, "q"), (901, "a b " * 5_000), (7, "a b " * 0)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, buckets=3, budget=60).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((d or -1, len(plain(t)) + 1) for d, t in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.padded_to
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and len(b) == b[0].batch_docs
        assert sorted(r.batch_slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].padded_to <= 60
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    lens = spark.range(1, 5000).select("id", packing.candidate(packing.F.col("id")).alias("c")).collect()
    assert all(r.id <= r.c <= r.id * (1 + 1 / 128) + 1e-9 and (r.id > 256 or r.id == r.c) for r in lens)


def test_groups_split_a_hot_bucket(spark):
    counted = spark.range(5000).select("id", packing.F.lit(10).cast("long").alias("n_tokens"), "id").toDF("doc_id", "n_tokens", "mark")
    got = packing.pack(counted, 4, 100, group_docs=500).groupBy("batch").count().collect()
    assert len({r.batch.split("-")[1] for r in got}) == 10 and sum(r["count"] for r in got) == 5000 and max(r["count"] for r in got) == 10
