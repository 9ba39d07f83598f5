import re
from collections import Counter

from tillroll.llm import quality_rules as Q
from tillroll.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(hit))


def test_statistics_against_brute_force(spark):
    texts = [None, "", " \n ", "a b c d e " * 6, "x\x0by z\x0cq\r\n a  b", "l one\nl one\n\nl one\n l two", "# * $$ %&|<> ok",
             "a b c d e a b c d e f a b c d", "u v w x y " + " ".join(map(str, range(20))) + " u v w x y", "é é ß\U0001f600",
             " ".join(f"w{i % 4999}" for i in range(20_000)), "same", "same"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert Q.judge(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    Q.judge(spark.createDataFrame([], "doc_id long, text string")).explain()
    assert not re.search("Python|Pandas|Arrow|Exchange", capsys.readouterr().out)


def test_query_matches_sql(spark, duck):
    got = QUERIES["op4_quality_rules"](spark, SF)
    cur = duck.execute(ORACLE["op4_quality_rules"])
    cols = [d[0] for d in cur.description]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(cur.fetchall())
