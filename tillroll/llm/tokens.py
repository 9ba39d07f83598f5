"""Token ids of whole texts with a public tokenizer file, inside Spark tasks.

Byte-level BPE never joins characters across a single blank between two characters that are not
white space, so a text is the concatenation of its blank-separated units. A task encodes each
distinct unit once with the tokenizers library and looks the others up. A new unit such as a word with
a full stop is put together from its runs of letters and of other characters, which are remembered
too. Runs of letters go to the library's merge model directly, as its splitting has nothing to do there.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

# Bytes that a worker's remembered units and runs may take, as estimated below; beyond that it forgets them all and goes on
# (results stay the same). Runs above LONG_RUN characters are not remembered.
CACHE_BYTES = 96 << 20
UNIT_BYTES = 150           # of a dictionary entry, its string and number
RUN_BYTES = 250            # the same with a tuple of ids
LONG_RUN = 200
_WIDE_GAP = re.compile(r"\s\s")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_STOPS = frozenset(".,;:!?")
_RUNS = re.compile(r" ?[^\W_]+|[\W_]+")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 letters stand for
    themselves, the other bytes for the letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Numbers:
    """Numbers of units, and the units that have one but no ids yet."""

    def __init__(self):
        self.n, self.new = 0, []


class _Units(dict):
    """Number of each unit; those after a blank are looked up without it."""

    def __init__(self, numbers: _Numbers, lead: str):
        super().__init__()
        self.numbers, self.lead = numbers, lead

    def __missing__(self, part: str) -> int:
        numbers = self.numbers
        at = self[part] = numbers.n
        numbers.n += 1
        numbers.new.append(self.lead + part)
        return at


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    wide = np.zeros(max(2 * len(array), used + more), array.dtype)
    wide[:used] = array[:used]
    return wide


class Encoder:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens in a text are ordinary text
        self.letters = byte_letters()
        self.limit = cache_bytes
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.first, self.led = _Units(self.numbers, ""), _Units(self.numbers, " ")
        self.runs: dict[str, tuple[int, ...]] = {}
        self.chars = 0
        # Ids of all units, one after the other, and their ends; both arrays double when they are full.
        self.flat, self.n_flat = np.zeros(1 << 12, np.uint32), 0
        self.ends = np.zeros(1 << 10, np.int64)
        self.n_units = 0

    def _held(self) -> int:
        return self.chars + self.numbers.n * UNIT_BYTES + len(self.runs) * RUN_BYTES + self.flat.nbytes + self.ends.nbytes

    def _run(self, run: str) -> tuple[int, ...]:
        ids = self.runs.get(run)
        if ids is None:
            if run.lstrip(" ").isalpha():
                spelt = run.encode().decode("latin-1").translate(self.letters)
                ids = tuple([t.id for t in self.tokenizer.model.tokenize(spelt)])
            else:
                ids = tuple(self.tokenizer.encode(run, add_special_tokens=False).ids)
            if len(run) <= LONG_RUN:
                self.runs[run] = ids
        return ids

    def _unit(self, unit: str) -> tuple[int, ...] | list[int]:
        body = unit.removeprefix(" ")
        if body.isalpha():
            return self._run(unit)
        if body[-1:] in _STOPS and body[:-1].isalpha() and body[-2] < "\u2000":
            return self._run(unit[:-1]) + self._run(body[-1])
        # Apostrophes (contractions), wide gaps and letters beyond U+2000, where tables of
        # character classes may differ, are left to the library as a whole.
        if "'" in unit or max(unit, default="") >= "\u2000" or _WIDE_GAP.search(unit):
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        return [i for run in _RUNS.findall(unit) for i in self._run(run)]

    def _learn(self) -> None:
        new = self.numbers.new
        if new:
            ids = [self._unit(u) for u in new]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            total, n = int(lens.sum()), len(ids)
            self.flat = _room(self.flat, self.n_flat, total)
            self.ends = _room(self.ends, self.n_units + 1, n)
            self.flat[self.n_flat:self.n_flat + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.ends[self.n_units + 1:self.n_units + 1 + n] = self.n_flat + np.cumsum(lens)
            self.n_flat, self.n_units = self.n_flat + total, self.n_units + n
            self.chars += sum(map(len, new))
            self.numbers.new = []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each (null: none)."""
        found, sizes = [], []
        get, get_led = self.first.__getitem__, self.led.__getitem__
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            parts = _SINGLE_BLANK.split(text) if _WIDE_GAP.search(text) else text.split(" ")
            found.append(get(parts[0]))
            found.extend(map(get_led, parts[1:]))
            sizes.append(len(parts))
        self._learn()
        unit = np.array(found, np.int64)
        begin = self.ends[unit]
        lens = self.ends[unit + 1] - begin
        ends = np.cumsum(lens)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - lens), lens)]
        per_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])
        if self._held() > self.limit:
            self._forget()
        return ids, per_text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker (loading a file takes a second)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

