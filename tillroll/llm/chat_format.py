"""Chat formatting by schema fingerprints.

A record's nested field paths (``messages[].role``) are sorted and hashed. The hash selects one of
the declarative layouts below, which says how the record's fields become canonical turns
``(role, text)``. The turns are then written with one template, whose control strings are escaped
inside texts, so that the turns can be read back exactly.

Defined results: a null text or role is empty; an unknown fingerprint, invalid JSON or a null record
gives ``layout`` null, no turns and a null ``formatted`` (the row stays, with its fingerprint, so that
new layouts can be declared); an empty list of messages gives zero turns and an empty text. Rows of one
conversation are ordered by (turn, role, text), repeated rows stay repeated turns; a row with a null
conversation id is a conversation of its own. Extra columns are ignored. One conversation is one
output row, as one training example is, so it must fit a row.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

# A control string with backslashes after its first character; escaping adds one, unescaping
# removes one. No control string holds a backslash, so the two are inverse on every text.
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_TAILS})")
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


# ------------------------------------------------------------------- layouts and fingerprints
@dataclass(frozen=True)
class Each:
    """A turn for each element of a list."""
    items: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """One turn of a fixed role from top-level fields, joined by a blank line (absent or empty
    fields are left out); no turn when ``optional`` and all are empty."""
    role: str
    fields: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    turns: tuple[Each | One, ...]
    optional: tuple[str, ...] = ("id", "source")


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("turn_rows", ("messages[].role", "messages[].text"), (Each("messages", "role", "text"),)),
    Layout("messages", ("messages[].content", "messages[].role"), (Each("messages", "role", "content"),),
           ("id", "source", "messages[].name")),
    Layout("from_value", ("conversations[].from", "conversations[].value"),
           (Each("conversations", "from", "value"),), ("id", "source", "system")),
    Layout("instruction", ("instruction", "output"),
           (One("system", ("system",), True), One("user", ("instruction", "input")), One("assistant", ("output",))),
           ("id", "source", "input", "system")),
    Layout("prompt_completion", ("completion", "prompt"),
           (One("system", ("system",), True), One("user", ("prompt",)), One("assistant", ("completion",))),
           ("id", "source", "system")),
    Layout("prompt_response", ("prompt", "response"),
           (One("system", ("system",), True), One("user", ("prompt",)), One("assistant", ("response",))),
           ("id", "source", "system")),
    Layout("question_answer", ("answer", "question"),
           (One("user", ("context", "question")), One("assistant", ("answer",))), ("id", "source", "context")),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; a list is ``[]`` whatever its length, an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint -> layout, for every choice of the optional paths and for empty lists."""
    out: dict[str, Layout] = {}
    for lay in layouts:
        bare = {re.sub(r"\[\].*", "[]", p) for p in lay.required}
        for n in range(len(lay.optional) + 1):
            for extra in itertools.combinations(lay.optional, n):
                for base in (set(lay.required), bare):
                    paths = base | {p for p in extra if base is not bare or "[]" not in p}
                    if out.setdefault(fingerprint(paths), lay).name != lay.name and base is not bare:
                        raise ValueError(f"layouts {lay.name} and {out[fingerprint(paths)].name} have the same paths")
    return out


def _string(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def to_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    turns = []
    for rule in layout.turns:
        if isinstance(rule, Each):
            if rule.items == "conversations" and record.get("system"):
                turns.append(("system", _string(record["system"])))
            for item in record.get(rule.items) or []:
                role = _string(item.get(rule.role))
                turns.append((ROLES.get(role, role) if rule.role == "from" else role, _string(item.get(rule.text))))
        else:
            texts = [t for t in (_string(record.get(f)) for f in rule.fields) if t]
            if texts or not rule.optional:
                turns.append((rule.role, "\n\n".join(texts)))
    return turns


def write_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code point spans of the texts that the loss is taken over."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


# ------------------------------------------------------------------------------ DataFrames
def records_from_turns(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation from rows ``(conv_id, turn, role, text)``."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = (rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(item)).alias("m")))
    loose = rows.where(F.col("conv_id").isNull()).select("conv_id", F.array(item).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return keyed.unionByName(loose).select(
        "conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


FORMATTED = "{id} {type}, fingerprint string, layout string, n_turns int, formatted string, loss_spans array<struct<start:int,end:int>>"


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record",
                   layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical, formatted conversations of JSON records of any declared layout."""
    kind = records.schema[id_col].dataType.simpleString()
    schema = FORMATTED.format(id=f"`{id_col}`", type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                try:
                    record = None if text is None else json.loads(text)
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record)) if isinstance(record, dict) else None
                lay = known.get(mark)
                if lay is None:
                    row = (mark, None, 0, None, [])
                else:
                    turns = to_turns(record, lay)
                    out, spans = write_turns(turns)
                    row = (mark, lay.name, len(turns), out, [{"start": a, "end": b} for a, b in spans])
                for c, v in zip(cols, row):
                    c.append(v)
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=[id_col, "fingerprint", "layout", "n_turns", "formatted", "loss_spans"])

    return records.select(id_col, record_col).mapInArrow(run, schema)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Checksums of what :func:`format_records` wrote, taken from the turns and the loss texts that are
    read back from the formatted text and its spans."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans or [])
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                row = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                       hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for c, v in zip(cols, row):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(id_col, "formatted", "loss_spans").mapInArrow(
        run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
