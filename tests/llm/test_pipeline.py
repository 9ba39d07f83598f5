import re
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tillroll.llm import quality_trees, toxicity
from tillroll.llm.common import store

from .test_decontaminate import brute as leaks
from .test_jaccard_join import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = store(stage(spark, docs, SF), "stage")
        rows = out.collect()
        if name == "toxicity":
            m = toxicity.train(docs, labels)
            want = {d for d, t in before.items() if m.scores([t])[0] < 0.3}
        elif name == "quality classifier":
            got = quality_trees.score(docs, quality_trees.train(docs, labels)).collect()
            want = {r.doc_id for r in got if r.predicted}
        elif name == "n-gram jaccard join":
            want = {c for _, _, c in classes(list(before.items()))}
        elif name == "benchmark decontamination":
            want = {r[0] for r in leaks(list(before.items()), items) if not r[-1]}
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert {r.doc_id: r.n_tokens for r in rows} == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in before.items()}
            batches = defaultdict(list)
            for r in rows:
                batches[r.batch].append(r)
            assert all(len(b) == 1 or len(b) * b[0].padded_to <= 32_768 for b in batches.values())
            break
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in rows) == sorted(want), name
        assert all(before[r.doc_id] == r.text for r in rows)
        seen.append(len(rows))
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * len(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c d e", "en", "s", 9), (None, None, "en", "s", 9), (2, "", "", "", 0),
                                 (3, "the same old text of the day", "en", "s", 1), (3, "the same old text of the day", "en", "s", 1)], schema)
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in P.STAGES:
            docs = store(stage(spark, docs, SF), "odd")
        assert docs.count() == (n and docs.count()) and re.match("doc_id", docs.columns[0])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near(docs, size=5, percent=80):
    """The kept (doc_id, text) rows by brute force: of each class the row with the smallest id."""
    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()

    sets, group = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    classes = defaultdict(list)
    for g, row in zip(group, docs):
        classes[g].append(row)
    return sorted((min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()), key=str)


def test_near_copies_between_the_limits_of_op9_and_the_stage(spark):
    base, tail = [f"w{i}" for i in range(500)], [f"t{i}" for i in range(140)]
    rows = [(1, " ".join(base)), (2, " ".join(base + tail[:100])), (3, " ".join(base + tail)), (4, "a b c d e f"), (5, "a b c d e g")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    got = P.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == near(rows) and sorted(r.doc_id for r in got) == [1, 4, 5]


def test_rows_of_one_id_or_none_are_judged_one_by_one(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " z"), (None, text("c")), (None, text("c")), (None, text("c") + " y"),
            (None, text("d")), (None, text("a")), (3, text("e")), (3, text("e")), (3, text("e") + " x"), (4, None), (4, ""), (5, ""), (5, ""),
            (6, "said " + item + " again"), (6, text("f")), (None, "seen " + item), (None, text("g"))]
    docs = spark.createDataFrame([(*r, "en", "s", i) for i, r in enumerate(rows)], DOCS)
    kept = store(P.drop_near_duplicates(spark, docs, SF), "rows")
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    texts = [t for _, t in got if t]
    classes = near([r for r in dict.fromkeys(rows)])
    assert kept.columns == docs.columns and [r[0] for r in got] == [r[0] for r in classes]
    assert len(near(got)) == len(got)  # no two of the kept rows are linked
    assert {(1, text("a")), (1, text("b")), (None, text("d")), (4, None), (4, ""), (5, "")} <= set(got) and text("b") + " z" not in texts
    assert got.count((5, "")) == 1 and sum(r[0] == 3 for r in got) == 1 and sum(t.startswith(text("c")) for t in texts) == 1

    clean = [tuple(r) for r in P.drop_contaminated(spark, docs, SF).select("doc_id", "text").collect()]
    assert sorted(clean, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_clashing_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "doc_id AS _key", "'x' AS _KEY_")
    for stage in (P.drop_near_duplicates, P.drop_contaminated):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(r["_key"] == r.doc_id for r in out.collect())
