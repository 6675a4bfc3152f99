"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of character classes,
repeated neighbouring words and lengths, of itself and of its neighbouring
lines; a 2 x 2 transition couples neighbours. Forward-backward gives each
line's marginal, and the length-weighted mean of the marginals, calibrated on
the training documents, is the document's score.

Lines inherit their document's label for training, on a bounded sample of
labelled rows (`max_docs`); long training texts are split into chains of at most 64
lines. Scoring is one pass without a shuffle, vectorised over slices of a
batch, all lines of all texts; texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, map_text, runs, unicode_tables

#: Labelled documents that the model is fitted on, about.
MAX_DOCS = 2000
CHAIN = 64
FEATURES = 11
ODD = "#$%&*|!~^<>{}[]\\=+_@"


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, FEATURES), the length of each line, and the first line of each text (one more than texts)."""
    codes, offset = code_points(texts)
    kind = unicode_tables()["kind"][codes]
    newline = codes == 10
    ends = np.flatnonzero(newline)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first = np.searchsorted(starts, offset)
    length = (ends - starts).astype(np.float64)
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), starts).astype(np.float64)
    letters, upper, digits, spaces = total((kind == 1) | (kind == 2) | (kind == 6)), total(kind == 2), total(kind == 3), total(kind == 4) - 1
    odd_table = np.zeros(128, dtype=bool)
    odd_table[[ord(c) for c in ODD]] = True
    odd = total((codes < 128) & odd_table[np.minimum(codes, 127)])
    solid = kind != 4
    w0, w1 = runs(solid)
    n = len(starts)
    if len(w0):
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(w0, w1 - w0).astype(np.uint64)[np.cumsum(solid) - 1]
        mixed = (codes.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = np.where(solid, mixed ^ (mixed >> np.uint64(29)), 0)
        word = np.add.reduceat(mixed, w0)
        line = np.searchsorted(starts, w0, side="right") - 1
        same = np.concatenate(([False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])))
        lone = (w1 - w0 == 1) & (kind[w0] == 5)
        capital = kind[w0] == 2
        words = np.bincount(line, minlength=n).astype(np.float64)
        repeats, lones = np.bincount(line, weights=same, minlength=n), np.bincount(line, weights=lone, minlength=n)
        capitals = np.bincount(line, weights=capital, minlength=n)
    else:
        words = repeats = lones = capitals = np.zeros(n)
    some, has = np.maximum(length, 1), np.maximum(words, 1)
    f = np.stack(
        [
            letters / some, upper / np.maximum(letters, 1), digits / some, odd / some, np.maximum(spaces, 0) / some, repeats / has,
            lones / has, capitals / has, np.minimum((length - spaces) / has, 20) / 10, np.log1p(length) / 8, (length == 0).astype(float),
        ],
        axis=1,
    )
    return f, length, first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a constant; zeros beyond the text."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first[:-1][first[:-1] < len(f)]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([f, before, after, np.ones((len(f), 1))], axis=1)


def forward_backward(u: np.ndarray, a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of good for each line, expected transitions (2, 2), and the log-partition sum. `u`: log-odds of good; `a`: (2, 2)."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    e = np.exp(a - a.max())
    unary = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], axis=1)
    alpha, beta = np.zeros((len(u), 2)), np.ones((len(u), 2))
    logz = 0.0
    p = None
    for t in range(steps):
        n = active[t]
        at = begin[:n] + t
        p = unary[at] if t == 0 else (p[:n] @ e) * unary[at]
        z = p.sum(axis=1, keepdims=True)
        logz += float(np.log(z).sum()) + (a.max() * n if t else 0.0)
        p = p / z
        alpha[at] = p
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        n = active[t]
        at = begin[:n] + t
        right = unary[at] * beta[at]
        b = right @ e.T
        joint = alpha[at - 1][:, :, None] * e[None] * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    g = alpha * beta
    return g[:, 1] / np.maximum(g.sum(axis=1), 1e-300), pairs, logz


@dataclass
class Model:
    w: np.ndarray
    a: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def doc_marginals(texts: list[str | None], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length-weighted mean marginal of each text, and per line: marginal, length, first line of each text."""
    f, length, first = line_features(texts)
    p, _, _ = forward_backward(with_neighbours((f - m.mean) / m.scale, first) @ m.w, m.a, first)
    weight = np.where(length > 0, length, 1e-6)
    return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), p, length, first


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(rows: list[tuple[str | None, int]], rate_of_one: float | None = None, rounds: int = 150) -> Model:
    """Fit on (text, label) rows by gradient ascent (Adam) on the chains' log-likelihood, then calibrate."""
    m = Model(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES))
    if len({y for _, y in rows}) < 2:
        m.shift = 3.0 if rows and rows[0][1] else (-3.0 if rows else 0.0)
        m.slope = 0.0
        return m
    texts, y = [t for t, _ in rows], np.array([label for _, label in rows])
    f, _, first = line_features(texts)
    m.mean, m.scale = f.mean(axis=0), f.std(axis=0) + 1e-3
    x = with_neighbours((f - m.mean) / m.scale, first)
    label = np.repeat(y, np.diff(first)).astype(float)
    chain = np.unique(np.concatenate([first, *[np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > CHAIN]]))
    inner = np.ones(len(x), dtype=bool)
    inner[chain[:-1]] = False
    seen = np.zeros((2, 2))
    to = np.flatnonzero(inner)
    np.add.at(seen, (label[to - 1].astype(int), label[to].astype(int)), 1)
    theta = np.zeros(len(m.w) + 4)
    g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), chain)
        grad = np.concatenate([x.T @ (label - p), (seen - pairs).ravel()]) / len(x) - 1e-3 * theta
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        theta += 0.1 * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.999**k)) + 1e-8)
    m.w, m.a = theta[:-4], theta[-4:].reshape(2, 2)
    z = logit(doc_marginals(texts, m)[0])
    m.slope, m.shift = platt(z, y)
    m.shift += prior_shift(rate_of_one, y)
    return m


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y on z with softened targets, by Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        b += np.clip(np.linalg.solve(h, x.T @ (target - p) - 1e-3 * (b - [1.0, 0.0])), -1, 1)
    return float(b[0]), float(b[1])


def prior_shift(rate_of_one: float | None, y: np.ndarray) -> float:
    """What a score's log-odds gain by going from the share of label 1 in `y` to `rate_of_one`."""
    if rate_of_one is None or not 0 < rate_of_one < 1:
        return 0.0
    one = (y.sum() + 0.5) / (len(y) + 1)
    return float(np.log(rate_of_one / (1 - rate_of_one)) - np.log(one / (1 - one)))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, use: Column, label: str, text: str, max_docs: int, id_col: str = "doc_id", share_of_one: float = 0.5
) -> tuple[list[tuple[str, int]], float | None]:
    """About `max_docs` labelled rows where `use` holds (never over twice that), by a hash of the id, and the share of label 1 among all.

    `share_of_one` of the bound goes to label 1, the rest to label 0. Null labels and null texts teach nothing; of an id's several labels the largest counts.
    """
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & use).groupBy(f"`{id_col}`").agg(
        F.max(F.when(F.col(f"`{label}`") > 0, 1).otherwise(0)).alias("__y")
    )
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if not counts:
        return [], None
    h = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(11)), F.lit(1_000_000))
    part = F.lit(False)
    for y, n in counts.items():
        wanted = min(1.0, max_docs * (share_of_one if y else 1 - share_of_one) / n)
        part = part | ((F.col("__y") == y) & (h < int(1_000_000 * wanted) + 1))
    chosen = known.where(part).limit(2 * max_docs)
    rows = docs.join(F.broadcast(chosen), id_col).where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{text}`").alias("text"), "__y", h.alias("h")
    )
    picked = sorted(rows.limit(4 * max_docs).collect(), key=lambda r: (r["h"], r["text"]))
    return [(r["text"], r["__y"]) for r in picked], counts.get(1, 0) / sum(counts.values())


def score_quality(
    docs: DataFrame, labels: DataFrame, keep: list[str], learn_from: Column, max_docs: int = MAX_DOCS, lines: bool = False,
    label: str = "quality", text: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """Per row of `docs`: `keep` columns, score (0 to 1) and, if asked for, line_good, the marginal of each line.

    Null and empty texts are one empty line and are scored like any other. With labels of one kind only (or
    none) every text gets one score. Repeated rows stay; an empty table gives an empty result.
    """
    model = train(*labelled_rows(docs, labels, learn_from, label, text, max_docs, id_col))

    def kernel():
        def score(texts):
            z, p, _, first = doc_marginals(texts, model)
            made = {"score": pa.array(1 / (1 + np.exp(-np.clip(model.slope * logit(z) + model.shift, -30, 30))))}
            if lines:
                made["line_good"] = pa.array([p[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.float64()))
            return made

        return score

    return map_text(docs, keep, kernel, "score double" + (", line_good array<double>" if lines else ""), text=text)
