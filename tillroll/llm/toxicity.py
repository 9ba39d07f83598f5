"""Toxic spans with a linear-chain conditional random field.

Tokens (``\\w+``) are tagged 0 or 1. The emission score of a token is the sum of hashed features of its
lower-cased form (the word, prefixes of 3 to 6 letters, the last 3 letters); transitions between
neighbouring tags are learnt too. Forward-backward marginals give the probability of tag 1 for every
token; a document's score is a logistic function of the largest marginal and of the expected number of
toxic tokens, and its spans are the runs of tokens with a marginal of at least 0.5.

Only documents are labelled, so the token labels are derived first: a word or prefix that occurs in
labelled toxic documents and in (almost) no clean one, more often than chance explains, marks its tokens
in toxic documents. This is repeated over the toxic documents that have no marked token yet, as chance
explains less the fewer they are. Clean documents have clean tokens; toxic documents without any marked
token are left out of the token fit.

The fit takes at most ``FIT_DOCS`` labelled documents of at most ``FIT_CHARS`` characters (a random sample
in hash order), which is a bound of what reaches the driver. Scoring reads whole texts of every row, in
chains of ``CHAIN`` tokens.

Defined results: a null or empty text has no tokens and the score of no evidence; repeated rows score
alike; an empty table gives no rows; without toxic labels every score is 0.0 to 0.05. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import held_out, labelled_ids, text_slices

FIT_DOCS, FIT_CHARS = 12_000, 20_000
CHAIN = 64
DIMS = 1 << 18
CUE_SLOTS = 1 << 24    # hash slots in which cues are counted
N_FEATURES = 6
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.3, 1e-6
CHANCE = 1e-4          # a cue that labels tokens must be rarer than this by chance
CLEAN_CHAINS = 12_000  # clean chains that the token fit takes
CACHE_WORDS = 400_000
_WORD = re.compile(r"\w+")


def cues(word: str) -> list[str]:
    """Feature names of a lower-cased token, always :data:`N_FEATURES` of them."""
    return ["w" + word, *(f"{n}" + word[:n] for n in (3, 4, 5, 6)), "e" + word[-3:]]


def cue_ids(word: str) -> list[int]:
    return [zlib.crc32(c.encode()) & (CUE_SLOTS - 1) for c in cues(word)]


# -------------------------------------------------------------------------- chains and marginals
def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 and pair marginals summed over each chain.

    ``emit`` (chains, length): score of tag 1 against tag 0; ``mask``: real tokens, which fill a chain
    from its start; ``trans`` (2, 2): transition scores. Returns (chains, length) and (chains, 2, 2).
    """
    n, length = emit.shape
    e = np.exp(np.clip(emit, -30, 30))
    t = np.exp(trans)
    alpha, beta = np.zeros((n, length, 2)), np.ones((n, length, 2))
    scale = np.ones((n, length))
    now = np.stack([np.ones(n), e[:, 0]], axis=1)
    for k in range(length):
        if k:
            now = alpha[:, k - 1] @ t
            now[:, 1] *= e[:, k]
        scale[:, k] = now.sum(axis=1)
        alpha[:, k] = now / scale[:, k, None]
    for k in range(length - 2, -1, -1):
        right = beta[:, k + 1].copy()
        right[:, 1] *= e[:, k + 1]
        b = (right @ t.T) / scale[:, k + 1, None]
        beta[:, k] = np.where(mask[:, k + 1, None], b, 1.0)
    both = alpha * beta
    both /= both.sum(axis=2, keepdims=True)
    right = beta[:, 1:].copy()
    right[..., 1] *= e[:, 1:]
    pair = alpha[:, :-1, :, None] * t * right[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    pair = (pair * mask[:, 1:, None, None]).sum(axis=1)
    return both[..., 1] * mask, pair


def marginals(emit: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of a flat run of tokens; ``doc`` (ascending) tells where a text ends. Chains are runs
    of at most :data:`CHAIN` tokens of one text."""
    if not len(emit):
        return np.zeros(0)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    place = (np.arange(len(doc)) - begin) % CHAIN
    chain = np.cumsum(place == 0) - 1
    grid = np.zeros((chain[-1] + 1, CHAIN))
    mask = np.zeros(grid.shape, bool)
    grid[chain, place], mask[chain, place] = emit, True
    return forward_backward(grid, mask, trans)[0][chain, place]


# --------------------------------------------------------------------------------------- model
@dataclass
class Tagger:
    weights: np.ndarray
    trans: np.ndarray
    link: np.ndarray                   # logistic weights: constant, log odds of the largest marginal, log1p expected count
    bias: float = 0.0                  # added to every emission; -10 in a model without labelled tokens
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def emit(self, words: list[str]) -> np.ndarray:
        known = self.seen
        new = {w for w in words if w not in known}
        if new:
            if len(known) > CACHE_WORDS:
                known.clear()
                new = set(words)
            w = self.weights
            known.update((x, float(sum(w[i & (DIMS - 1)] for i in cue_ids(x.lower())))) for x in new)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words)) + self.bias

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and marginal of every token."""
        words = [_WORD.findall(t or "") for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        return doc, marginals(self.emit([x for w in words for x in w]), doc, self.trans)

    def evidence(self, texts: list[str | None], tagged: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        doc, p = tagged or self.tag(texts)
        most = np.zeros(len(texts))
        np.maximum.at(most, doc, p)
        odds = np.clip(most, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(len(texts)), np.log(odds / (1 - odds)) / 4,
                         np.log1p(np.bincount(doc, p, len(texts)))], axis=1)

    def scores(self, texts: list[str | None], tagged: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts, tagged) @ self.link, -30, 30)))

    def spans(self, text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
        """Code point offsets of the runs of tokens with a marginal of ``least`` or more."""
        out: list[tuple[int, int]] = []
        for k, m in enumerate(_WORD.finditer(text)):
            if p[k] >= least:
                if out and k and p[k - 1] >= least:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
        return out


def token_cues(words: list[np.ndarray], table: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words (rows of ``table``, the cue slots of the vocabulary) label tokens: by chance all the
    documents of one of their cues would be toxic less often than :data:`CHANCE`. One clean document in
    twenty is forgiven. ``words``: the distinct words of each document."""
    labels = table[:, :-1]  # the ending alone labels nothing
    clean = np.zeros(CUE_SLOTS, np.int32)
    for i in np.flatnonzero(~toxic):
        clean[np.unique(labels[words[i]])] += 1
    marked = np.zeros(len(table), bool)
    while True:
        rest = [i for i in np.flatnonzero(toxic) if not marked[words[i]].any()]
        if not rest:
            return marked
        bad = np.zeros(CUE_SLOTS, np.int32)
        for i in rest:
            bad[np.unique(labels[words[i]])] += 1
        share = min(max(len(rest) / (len(rest) + int((~toxic).sum())), 0.01), 0.9)
        least = max(3, math.ceil(math.log(CHANCE) / math.log(share)))
        new = ((bad >= least) & (clean * 20 <= bad))[labels].any(axis=1) & ~marked
        if not new.any():
            return marked
        marked |= new


def fit_link(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls: whole steps diverge
    where the evidence parts almost all documents."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * w @ w)

    link = np.zeros(x.shape[1])
    now = loss(link)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(link))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * link)
        while (new := loss(link - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if new >= now:
            break
        link, now = link - step, new
    return link


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Tagger:
    toxic = np.asarray(toxic, bool)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in _WORD.findall((t or "").lower())], np.int32) for t in texts]
    table = np.array([cue_ids(w) for w in ids], np.int32).reshape(-1, N_FEATURES)
    marked = token_cues([np.unique(d) for d in docs], table, toxic)
    model = Tagger(np.zeros(DIMS), np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0]))
    if not marked.any():
        model.bias = -10.0
        return model
    rng = np.random.default_rng(seed)
    toxic_chains, clean_chains = [], []
    for d, t in zip(docs, toxic):
        if not t or marked[d].any():
            (toxic_chains if t else clean_chains).extend((d[i:i + CHAIN], t) for i in range(0, len(d), CHAIN))
    chains = toxic_chains + [clean_chains[i] for i in rng.permutation(len(clean_chains))[:CLEAN_CHAINS]]
    table &= DIMS - 1
    word, y = np.zeros((2, len(chains), CHAIN), np.int32)
    mask = np.zeros((len(chains), CHAIN), bool)
    for i, (c, t) in enumerate(chains):
        word[i, :len(c)], y[i, :len(c)], mask[i, :len(c)] = c, marked[c] & t, True
    squares, tsquares = np.full(DIMS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            b = order[at:at + BATCH]
            f, m, t = table[word[b]], mask[b], y[b]
            p, pair = forward_backward(model.weights[f].sum(axis=2), m, model.trans)
            wrong = (p - t) * m
            busy = np.abs(wrong) > 1e-4
            grad = np.bincount(f[busy].ravel(), np.repeat(wrong[busy], N_FEATURES), DIMS) / len(b) + DECAY * model.weights
            real = np.zeros((2, 2))
            np.add.at(real, (t[:, :-1][m[:, 1:]], t[:, 1:][m[:, 1:]]), 1)
            tgrad = (pair.sum(axis=0) - real) / len(b) + 0.001 * model.trans
            squares += grad ** 2
            tsquares += tgrad ** 2
            model.weights -= RATE * grad / np.sqrt(squares)
            model.trans -= RATE * tgrad / np.sqrt(tsquares)
    x = np.concatenate([model.evidence(texts[i:i + 500]) for i in range(0, len(texts), 500)])
    model.link = fit_link(x, toxic)
    return model


# -------------------------------------------------------------------------------- DataFrames
def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2,
          max_docs: int = FIT_DOCS, max_chars: int = FIT_CHARS) -> Tagger:
    ids = labelled_ids(labels, label, parts, part, max_docs)
    got = (docs.select("doc_id", "text").where(F.length("text") <= max_chars)
           .join(F.broadcast(ids), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]))
    return fit(got.column("text").to_pylist(), got.column("label").to_numpy() > 0)


def score(docs: DataFrame, model: Tagger, parts: int = 4, part: int = 2, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_toxic_tokens, spans`` of every row; spans are code point
    offsets into the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for piece in text_slices(batches):
            texts = piece.column(1).to_pylist()
            doc, p = tagger.tag(texts)
            s = tagger.scores(texts, (doc, p))
            high = np.bincount(doc[p >= 0.5], minlength=len(texts))
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            found = [[{"start": a, "end": b} for a, b in tagger.spans(t, p[cut[i]:cut[i + 1]])] if high[i] else []
                     for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)),
                 pa.array(high.astype(np.int32)), pa.array(found, span)],
                names=["doc_id", "held_out", "score", "predicted", "n_toxic_tokens", "spans"])

    return docs.select("doc_id", "text", held_out("doc_id", parts, part).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, n_toxic_tokens int, "
             "spans array<struct<start:int,end:int>>")
