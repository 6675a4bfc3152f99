"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words and characters: a hashed word vector beside the largest values of the hashed
vectors of its letter trigrams, and those of its prefixes. A window of `WINDOW` words runs through a GRU in both
directions, attention pools the states, and a logistic unit scores the window.
Every text is scored over all its overlapping windows; the highest window,
calibrated on the training documents, is the document's score.

Training is numpy only, on a bounded sample of labelled rows (`max_docs`). A
toxic document is toxic somewhere, so each of its windows competes: the first choice
follows word log-odds, later ones the network itself. The weights (about
11 MB, nearly all of them the vectors of hashed words, trigrams and prefixes) travel as a closure.
Scoring is one pass without a shuffle, vectorised over slices of a batch. All windows of a text count;
a text over `CHUNK` characters is read a run of windows at a time, so memory does not grow with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import code_points, map_text, runs, unicode_tables
from .quality import labelled_rows, platt, prior_shift

#: Labelled documents that the network is trained on, about, and the share of toxic ones among them.
MAX_DOCS, TOXIC_SHARE = 1800, 1 / 3
WINDOW, STRIDE = 32, 24
HIDDEN, EMBED = 8, 8
WORD_BITS, GRAM_BITS, PREFIX_BITS = 16, 14, 18
INPUTS = 3 * EMBED
LANES = 2048
#: Characters of a text whose windows are scored together.
CHUNK = 1 << 20
EPOCHS = 12
#: One row in so many is held back to calibrate the score.
HELD_BACK = 5
#: Documents added to either side of the log-odds that the vectors start from.
SMOOTHING = 4.0


@dataclass
class Tokens:
    word: np.ndarray  # hashed word of each token
    gram: np.ndarray  # hashed trigram of each letter, tokens one after the other
    prefix: np.ndarray  # hashed prefix that ends at each letter
    at: np.ndarray  # first letter of each token among the letters
    size: np.ndarray  # letters of each token
    first: np.ndarray  # first token of each text (one more than texts)
    begin: np.ndarray  # where each token begins, in code points of all texts with one between two


def tokens_of(texts: list[str | None]) -> Tokens:
    """Tokens are runs of letters, marks and digits, in lower case."""
    codes, offset = code_points(texts)
    tables = unicode_tables()
    kind = tables["kind"][codes]
    solid = (kind >= 1) & (kind <= 3) | (kind == 6)
    start, end = runs(solid)
    low = np.where(solid, tables["lower"][codes], 0).astype(np.uint32)
    before, after = np.concatenate(([0], low[:-1])).astype(np.uint32), np.concatenate((low[1:], [0])).astype(np.uint32)
    mixed = before * np.uint32(0x9E3779B1) + low * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    inside = mixed[solid]
    size = end - start
    at = (np.cumsum(size) - size).astype(np.int64)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return Tokens(none, none, none, none, none, np.zeros(len(offset), dtype=np.int64), none)
    place = (np.arange(len(inside), dtype=np.int64) - np.repeat(at, size)).astype(np.uint32)
    letter = low[solid]
    spun = (letter + place * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    spun = np.cumsum(spun ^ (spun >> np.uint32(13)), dtype=np.uint32)
    whole = spun - np.repeat(spun[at] - _first(letter[at]), size)
    whole ^= whole >> np.uint32(16)
    whole *= np.uint32(0x7FEB352D)
    return Tokens(
        (whole[at + size - 1] >> np.uint32(32 - WORD_BITS)).astype(np.int64),
        (inside >> np.uint32(32 - GRAM_BITS)).astype(np.int64),
        (whole >> np.uint32(32 - PREFIX_BITS)).astype(np.int64),
        at,
        size,
        np.searchsorted(start, offset),
        start,
    )


def _first(letter: np.ndarray) -> np.ndarray:
    """What a token's first letter adds to the running sum."""
    spun = letter * np.uint32(0x165667B1)
    return spun ^ (spun >> np.uint32(13))


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of all overlapping windows: every STRIDE words until the text's end is covered."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][text] + k * STRIDE
    return start, np.minimum(WINDOW, first[1:][text] - start), text


class Network:
    """Parameters by name, float32; the two directions are stacked on the first axis."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "word": f(1 << WORD_BITS, EMBED, s=0.02), "gram": f(1 << GRAM_BITS, EMBED, s=0.02),
            "prefix": f(1 << PREFIX_BITS, EMBED, s=0.02), "wx": f(2, INPUTS, 3 * HIDDEN, s=0.35),
            "bx": np.zeros((2, 1, 3 * HIDDEN), dtype=np.float32), "u": f(2, HIDDEN, 3 * HIDDEN, s=0.3), "att": f(2, HIDDEN, s=0.3),
            "out": f(2, HIDDEN, s=0.3), "bias": np.zeros(1, dtype=np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, t: Tokens) -> np.ndarray:
        """(tokens, INPUTS): word vector beside the maxima over its trigrams' and its prefixes' vectors."""
        x = np.zeros((len(t.word), INPUTS), dtype=np.float32)
        if len(x):
            x[:, :EMBED] = self.p["word"][t.word]
            x[:, EMBED : 2 * EMBED] = np.maximum.reduceat(self.p["gram"][t.gram], t.at, axis=0)
            x[:, 2 * EMBED :] = np.maximum.reduceat(self.p["prefix"][t.prefix], t.at, axis=0)
        return x

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x (WINDOW, lanes, INPUTS), mask (WINDOW, lanes) -> logits; with keep also what backward needs."""
        p, h3, steps = self.p, HIDDEN, x.shape[0]
        g = np.empty((steps, 2, x.shape[1], 3 * h3), dtype=np.float32)
        np.add(x @ p["wx"][0], p["bx"][0], out=g[:, 0])
        np.add(x[::-1] @ p["wx"][1], p["bx"][1], out=g[:, 1])
        m = np.stack([mask, mask[::-1]], axis=1)[..., None].astype(np.float32)
        h = np.zeros((2, x.shape[1], h3), dtype=np.float32)
        states = np.empty((steps, 2, x.shape[1], h3), dtype=np.float32)
        cache = []
        whole = bool(mask.all())
        for t in range(steps):
            hu = h @ p["u"]
            zr = np.tanh((g[t, :, :, : 2 * h3] + hu[:, :, : 2 * h3]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[..., :h3], zr[..., h3:]
            n = np.tanh(g[t, :, :, 2 * h3 :] + r * hu[:, :, 2 * h3 :])
            new = n + z * (h - n)
            if keep:
                cache.append((h, z, r, n, hu[:, :, 2 * h3 :]))
            h = new if whole else h + m[t] * (new - h)
            states[t] = h
        both = np.stack([states[:, 0], states[::-1, 1]], axis=0)
        score = np.einsum("dtnh,dh->tn", both, p["att"])
        score = np.where(mask, score, np.float32(-1e9))
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,dtnh->dnh", a, both)
        logits = np.einsum("dnh,dh->n", pooled, p["out"]) + p["bias"][0]
        return (logits, (g, m, cache, both, a, pooled)) if keep else logits

    def backward(self, x, mask, kept, dlogit):
        """Gradients by parameter name (word and gram left out) and of x."""
        p, h3, steps = self.p, HIDDEN, x.shape[0]
        g, m, cache, both, a, pooled = kept
        d = {"out": np.einsum("n,dnh->dh", dlogit, pooled), "bias": np.array([dlogit.sum()], dtype=np.float32)}
        dpool = dlogit[None, :, None] * p["out"][:, None, :]
        da = np.einsum("dnh,dtnh->tn", dpool, both)
        ds = a * (da - (a * da).sum(axis=0))
        d["att"] = np.einsum("tn,dtnh->dh", ds, both)
        dboth = a[None, :, :, None] * dpool[:, None] + ds[None, :, :, None] * p["att"][:, None, None, :]
        dstates = np.stack([dboth[0], dboth[1][::-1]], axis=1)
        dg = np.empty_like(g)
        d["u"] = np.zeros_like(p["u"])
        dh = np.zeros_like(dstates[0])
        for t in range(steps - 1, -1, -1):
            h, z, r, n, hn = cache[t]
            dh = dh + dstates[t]
            dnew = dh * m[t]
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dn * r], axis=2)
            dg[t] = np.concatenate([dz, dr, dn], axis=2)
            d["u"] += np.swapaxes(h, 1, 2) @ dhu
            dh = dh * (1 - m[t]) + dnew * z + dhu @ np.swapaxes(p["u"], 1, 2)
        flat = x.reshape(-1, x.shape[2])
        back = np.ascontiguousarray(dg[::-1, 1]).reshape(-1, 3 * h3)
        fore = np.ascontiguousarray(dg[:, 0]).reshape(-1, 3 * h3)
        d["wx"] = np.stack([flat.T @ fore, flat.T @ back])
        d["bx"] = np.stack([fore.sum(axis=0), back.sum(axis=0)])[:, None, :]
        dx = (fore @ p["wx"][0].T + back @ p["wx"][1].T).reshape(x.shape)
        return d, dx


def gather(x: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (WINDOW, lanes, inputs), their mask and token positions."""
    step = np.arange(WINDOW)[:, None]
    mask = step < length[None, :]
    at = np.where(mask, start[None, :] + step, start[None, :])
    return x[at], mask, at


def part_of(t: Tokens, lo: int, hi: int) -> Tokens:
    """Tokens lo to hi with their letters."""
    a, b = int(t.at[lo]), int(t.at[hi - 1] + t.size[hi - 1])
    return Tokens(t.word[lo:hi], t.gram[a:b], t.prefix[a:b], t.at[lo:hi] - a, t.size[lo:hi], t.first, t.begin[lo:hi])


def window_logits(net: Network, t: Tokens, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logit of each window (starts in ascending order). LANES windows at a time, so vectors exist for those only."""
    out = np.empty(len(start), dtype=np.float32)
    for a in range(0, len(start), LANES):
        s, n = start[a : a + LANES], length[a : a + LANES]
        lo, hi = int(s[0]), int((s + n).max())
        w, mask, _ = gather(net.inputs(part_of(t, lo, hi)), s - lo, n)
        out[a : a + LANES] = net.forward(w, mask)
    return out


def highest(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each text its highest window; a text without words is at -8."""
    out = np.full(n, -8.0)
    np.maximum.at(out, text, logits)
    return out


def bucket_odds(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, held: np.ndarray, size: int) -> np.ndarray:
    """Per bucket, the smoothed log-odds of toxic documents among those that hold it, the held-back ones aside."""
    pair = np.unique(ids * (len(y) + 1) + doc)
    which, holder = pair // (len(y) + 1), pair % (len(y) + 1)
    one, none = (y == 1) & ~held, (y == 0) & ~held
    pos = np.bincount(which[one[holder]], minlength=size) / max(1, one.sum())
    neg = np.bincount(which[none[holder]], minlength=size) / max(1, none.sum())
    low = SMOOTHING / max(1, min(one.sum(), none.sum()))
    return np.log((pos + low) / (neg + low))


def train(rows: list[tuple[str | None, int]], rate_of_one: float | None = None, epochs: int = EPOCHS, seed: int = 5, from_odds: bool = True) -> Network:
    """Fit on (text, label) rows; with labels of one kind (or none) the score is a constant.

    The first number of each vector starts from its bucket's log-odds, unless `from_odds` is off.

    Every HELD_BACK-th row only calibrates. The rows are balanced: `rate_of_one`, the
    share of label 1 among all labelled rows, sets the score right.
    """
    net = Network(seed)
    if len({y for _, y in rows}) < 2:
        net.slope, net.shift = 0.0, (3.0 if rows and rows[0][1] else -3.0)
        return net
    y = np.array([label for _, label in rows])
    held = np.arange(len(y)) % HELD_BACK == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    t = tokens_of([text for text, _ in rows])
    start, length, text = windows_of(t.first)
    r = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    text_of = np.repeat(np.arange(len(y)), np.diff(t.first))
    of_letter = np.repeat(text_of, t.size)
    words = bucket_odds(t.word, text_of, y, held, 1 << WORD_BITS)
    grams = bucket_odds(t.gram, of_letter, y, held, 1 << GRAM_BITS)
    prefixes = bucket_odds(t.prefix, of_letter, y, held, 1 << PREFIX_BITS)
    for name, start_at in (("word", words), ("gram", grams), ("prefix", prefixes)):
        if from_odds:
            net.p[name][:, 0] = start_at / 2
    odds = np.maximum(words[t.word], np.maximum.reduceat(np.maximum(grams[t.gram], prefixes[t.prefix]), t.at))
    strength = np.array([odds[a : a + n].max() for a, n in zip(start, length, strict=True)])
    for epoch in range(epochs):
        if epoch in (3, 6, 9):
            strength = window_logits(net, t, start, length)
        order = np.lexsort((-strength, text))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        drawn = r.random(len(text)) < 2.0 / np.maximum(1, np.bincount(text, minlength=len(y)))[text]
        toxic = y[text] == 1
        chosen = np.flatnonzero(np.where(toxic, rank < 1, (rank < 2) | drawn) & ~held[text])
        r.shuffle(chosen)
        rate = 0.01 * (0.5 if epoch >= epochs // 2 else 1.0) * (0.4 if epoch >= epochs - 3 else 1.0)
        for a in range(0, len(chosen), 128):
            step += 1
            part = chosen[a : a + 128]
            _descend(net, t, start[part], length[part], toxic[part].astype(np.float32), moments, step, rate)
    z = highest(window_logits(net, t, start, length), text, len(y))
    use = held if held.any() else ~held
    net.slope, net.shift = platt(z[use], y[use])
    net.shift += prior_shift(rate_of_one, y[use])
    return net


def _descend(net, t, start, length, y, moments, step, rate) -> None:
    """One Adam step on a batch of windows; the embeddings' gradients are summed by bucket."""
    used = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(start, length, strict=True)]))
    size = t.size[used]
    letters = np.repeat(t.at[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.cumsum(size) - size
    ids = {"word": t.word[used], "gram": t.gram[letters], "prefix": t.prefix[letters]}
    vectors = {k: net.p[k][ids[k]] for k in ("gram", "prefix")}
    top = {k: np.maximum.reduceat(v, at, axis=0) for k, v in vectors.items()}
    x = np.concatenate([net.p["word"][ids["word"]], top["gram"], top["prefix"]], axis=1)
    w, mask, where = gather(x, np.searchsorted(used, start), length)
    logits, kept = net.forward(w, mask, keep=True)
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    d, dx = net.backward(w, mask, kept, ((p - y) / len(y)).astype(np.float32))
    per_token = np.zeros_like(x)
    np.add.at(per_token, where.ravel(), (dx * mask[..., None]).reshape(-1, x.shape[1]))
    for k, grad in d.items():
        _adam(net.p[k], grad, moments[k], slice(None), step, rate)
    _sparse(net, "word", ids["word"], per_token[:, :EMBED], moments, step, rate)
    for n, k in ((1, "gram"), (2, "prefix")):
        grad = np.repeat(per_token[:, n * EMBED : (n + 1) * EMBED], size, axis=0) * (vectors[k] == np.repeat(top[k], size, axis=0))
        _sparse(net, k, ids[k], grad, moments, step, rate)


def _sparse(net, name, ids, grad, moments, step, rate) -> None:
    """Only the buckets of this batch move."""
    rows, back = np.unique(ids, return_inverse=True)
    total = np.zeros((len(rows), grad.shape[1]), dtype=np.float32)
    np.add.at(total, back, grad)
    _adam(net.p[name], total, moments[name], rows, step, rate)


def _adam(p, grad, moment, rows, step, rate) -> None:
    one, two = moment
    one[rows] = 0.9 * one[rows] + 0.1 * grad
    two[rows] = 0.999 * two[rows] + 0.001 * grad * grad
    p[rows] -= (rate * (one[rows] / (1 - 0.9**step)) / (np.sqrt(two[rows] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def long_text_logit(net: Network, text: str, chunk: int = CHUNK) -> float:
    """The highest window of one text, a run of windows at a time: the same windows as of the whole text."""
    kind = unicode_tables()["kind"]
    solid = lambda c: 1 <= kind[ord(c)] <= 3 or kind[ord(c)] == 6
    at, size, top = 0, chunk, -8.0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and solid(text[end - 1]) and solid(text[end]):
            end += 1  # a word is not cut
        t = tokens_of([text[at:end]])
        start, length, which = windows_of(t.first)
        if end < len(text):
            whole = (len(t.word) - WINDOW) // STRIDE  # windows after which another one begins within these words
            if whole < 1:
                size *= 2  # hardly any words in so many characters
                continue
            start, length, which = start[:whole], length[:whole], which[:whole]
            end = at + int(t.begin[whole * STRIDE])
        top = max(top, float(highest(window_logits(net, t, start, length), which, 1)[0]))
        at, size = end, chunk
    return top


def score_texts(net: Network, texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
    long = [i for i, t in enumerate(texts) if t and len(t) > chunk]
    t = tokens_of([None if t and len(t) > chunk else t for t in texts])
    start, length, text = windows_of(t.first)
    z = highest(window_logits(net, t, start, length), text, len(texts))
    for i in long:
        z[i] = long_text_logit(net, texts[i], chunk)
    return 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -30, 30)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, keep: list[str], learn_from: Column, max_docs: int = MAX_DOCS, label: str = "toxic",
    text: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """Per row of `docs`: `keep` columns and score (0 to 1, higher: toxic).

    Null, empty and wordless texts get the score of a text without toxic windows. With labels of one kind only
    (or none) every text gets one score. Repeated rows stay; an empty table gives an empty result.
    """
    net = train(*labelled_rows(docs, labels, learn_from, label, text, max_docs, id_col, TOXIC_SHARE))

    def kernel():
        return lambda texts: {"score": pa.array(score_texts(net, texts).astype(np.float64))}

    return map_text(docs, keep, kernel, "score double", text=text)
