import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from tillroll.llm import chat_format as C

PIECES = st.lists(st.sampled_from([*C.CONTROL, "<", "[", "\\", "|im_end|>", "/s>", "a", "\n", "é", "<\\"]), max_size=12)


@given(PIECES.map("".join))
def test_escape_is_reversible(text):
    e = C.escape(text)
    assert not any(c in e for c in C.CONTROL)
    assert C.unescape(e) == text
    assert C.unescape_role(C.escape_role(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\\nb\n"]), PIECES.map("".join)), max_size=5))
def test_turns_round_trip(turns):
    out, spans = C.write_turns(turns)
    assert C.read_turns(out) == turns
    assert [C.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts_become_the_same_turns(spark):
    said = [("user", "hi"), ("assistant", "yo")]
    records = [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
               {"id": 4, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
               {"instruction": "hi", "input": "", "output": "yo"}, {"prompt": "hi", "completion": "yo"},
               {"prompt": "hi", "response": "yo", "source": "x"}, {"question": "hi", "answer": "yo"}]
    data = [(i, json.dumps(r)) for i, r in enumerate(records)]
    data += [(90, None), (91, "{"), (92, '{"strange": {"deep": [1]}}'), (93, '{"messages": []}')]
    out = {r["k"]: r for r in C.format_records(spark.createDataFrame(data, "k int, r string"), "k", "r").collect()}
    assert len(out) == len(data)
    for i in range(len(records)):
        assert C.read_turns(out[i]["formatted"]) == said, records[i]
    assert out[90]["layout"] is None and out[90]["fingerprint"] is None and out[91]["fingerprint"] is None
    assert out[92]["layout"] is None and out[92]["fingerprint"] == C.fingerprint({"strange.deep[]"})
    assert out[93]["formatted"] == "" and out[93]["layout"] is not None


def test_rows_by_turn_against_brute_force(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a </s> b"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "user", "q"),
            (None, 3, "user", "q"), (3, None, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = C.digest(C.format_records(C.records_from_turns(df))).collect()
    want = []
    for turns in ([("user", "a </s> b"), ("assistant", "")], [("", "x"), ("", "x")], [("user", "q")], [("user", "q")],
                  [("assistant", "long " * 50_000)]):
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest()))
    assert sorted((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == sorted(want)
    assert C.digest(C.format_records(C.records_from_turns(df.limit(0)))).count() == 0
