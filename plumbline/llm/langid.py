"""Language identification: script ranges, per-word scores, Viterbi spans.

Words are runs of letters and their marks. The script of a word's first letter narrows the
languages to those that were seen to use it; the word's score under each
language is the sum of its hashed letter-trigram log-probabilities; a Viterbi
pass with a switching penalty labels every word, so a text in several
languages falls into spans. The document's language is the one whose spans hold most
letters. What corpora call a mixed text differs: some name it after its opening
(it goes on to quote others). So the opening language's share gets a bonus, learned from
the labelled rows and 0 unless at least `EVIDENCE` more of them come out right with it.

The model is counted from a bounded sample of labelled rows
(`per_language` documents a language, chosen by hash, of the `max_languages` most frequent
languages) and travels as a closure of 2^18 x languages float32 (1 MB a language). Scoring is one pass without a shuffle, vectorised
over slices of a batch; texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, map_text, runs, slices, unicode_tables

#: Labelled documents that the model is fitted on, for each language, about.
PER_LANGUAGE = 400
#: Languages that the model tells apart at most, the most frequent ones.
MAX_LANGUAGES = 128
BUCKET_BITS = 18
#: Least probability of a trigram; equal for all languages.
UNSEEN = 1e-6
#: Most that one word can speak against a language.
WORST = -12.0
SWITCH = 14.0
#: Labelled rows that a bonus for the opening language must set right, net, before it is believed.
EVIDENCE = 3
#: Scores (words times languages) that texts in step hold at once, and looked-up values (letters times languages).
CELLS, LETTERS = 1 << 23, 1 << 22
#: Words from which on a text goes alone, in pieces of as many.
LONG_WORDS = 20_000
#: Share of a language's letters from which on it uses a script.
USES_SCRIPT = 0.01

#: First code point of script ranges; each runs up to the next. 0 is none.
SCRIPT_RANGES = [
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0300, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7),
    (0x0750, 6), (0x0780, 8), (0x0900, 9), (0x0980, 10), (0x0A00, 11), (0x0A80, 12), (0x0B00, 13), (0x0B80, 14), (0x0C00, 15),
    (0x0C80, 16), (0x0D00, 17), (0x0D80, 18), (0x0E00, 19), (0x0E80, 20), (0x0F00, 21), (0x1000, 22), (0x10A0, 23), (0x1100, 24),
    (0x1200, 25), (0x13A0, 26), (0x1780, 27), (0x1800, 28), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 29), (0x3100, 0),
    (0x3400, 30), (0xA000, 0), (0xAC00, 24), (0xD800, 0), (0xF900, 30), (0xFB00, 0), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1),
    (0xFF66, 29), (0xFFA0, 24), (0xFFE0, 0), (0x20000, 30), (0x32000, 0),
]
SCRIPTS = 31

_SCRIPT_OF: list[np.ndarray] = []


def script_table() -> np.ndarray:
    if not _SCRIPT_OF:
        first = np.array([a for a, _ in SCRIPT_RANGES])
        kind = np.array([k for _, k in SCRIPT_RANGES], dtype=np.uint8)
        _SCRIPT_OF.append(kind[np.searchsorted(first, np.arange(0x110000), side="right") - 1])
    return _SCRIPT_OF[0]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (2^BUCKET_BITS, languages), the best language of a trigram at 0
    uses: np.ndarray  # (SCRIPTS, languages) bool
    bonus: float = 0.0  # added to the share of the opening span's language


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray  # of each text in code points
    first: np.ndarray  # of each text's words
    script: np.ndarray
    trigram: np.ndarray  # of each letter, words one after the other
    at: np.ndarray  # first letter of each word among the letters


def words_of(texts: list[str | None]) -> Words:
    codes, offset = code_points(texts)
    tables = unicode_tables()
    kind = tables["kind"][codes]
    letter = (kind == 1) | (kind == 2)
    solid = letter | (kind == 6)
    start, end = runs(solid)
    opens = start
    if len(start) and not letter[start].all():  # some runs begin with a mark
        lettered = np.logical_or.reduceat(letter, start)
        for a, b in zip(start[~lettered].tolist(), end[~lettered].tolist(), strict=True):
            solid[a:b] = False  # marks alone are no word
        start, end = start[lettered], end[lettered]
        at_letter = np.flatnonzero(letter)
        opens = at_letter[np.searchsorted(at_letter, start)]
    letter = solid
    low = np.where(letter, tables["lower"][codes], 0).astype(np.uint32)
    before, after = np.concatenate(([0], low[:-1])).astype(np.uint32), np.concatenate((low[1:], [0])).astype(np.uint32)
    mixed = before * np.uint32(0x9E3779B1) + low * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    trigram = (mixed >> np.uint32(32 - BUCKET_BITS))[letter]
    at = np.concatenate(([0], np.cumsum(end - start)))[:-1] if len(start) else np.zeros(0, dtype=np.int64)
    return Words(start, end, offset, np.searchsorted(start, offset), script_table()[codes[opens]], trigram, at)


def train(labelled: list[tuple[str | None, str]]) -> Model:
    """Trigram and script counts of (text, language) rows; rows without letters or language teach nothing."""
    languages = sorted({lang for _, lang in labelled if lang is not None})
    size = 1 << BUCKET_BITS
    p = np.full((size, len(languages)), UNSEEN, dtype=np.float64)
    uses = np.zeros((SCRIPTS, len(languages)), dtype=bool)
    for k, lang in enumerate(languages):
        w = words_of([t for t, x in labelled if x == lang])
        counts = np.bincount(w.trigram, minlength=size)
        p[:, k] += counts / max(1, counts.sum())
        scripts = np.bincount(w.script, weights=w.end - w.start, minlength=SCRIPTS)
        uses[:, k] = scripts > USES_SCRIPT * max(1, scripts.sum())
    logp = np.log(p)
    if len(languages):
        logp -= logp.max(axis=1, keepdims=True)
    m = Model(languages, logp.astype(np.float32), uses)
    m.bonus = opening_bonus(labelled, m)
    return m


def shares_of(w: Words, m: Model, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the share of letters in spans of each language, the opening language (0 without words), and per word its language.

    Words in a script that no language uses count among all letters, but for no language.
    """
    label = labels_of(w, m)
    k = len(m.languages)
    text_of = np.repeat(np.arange(n), np.diff(w.first))
    size = w.end - w.start
    known = m.uses.any(axis=1)[w.script]
    letters = np.bincount(text_of * k + label, weights=size * known, minlength=n * k).reshape(n, k)
    total = np.bincount(text_of, weights=size, minlength=n)
    opening = np.zeros(n, dtype=np.int64)
    first_known = np.searchsorted(np.flatnonzero(known), w.first[:-1])
    at_known = np.append(np.flatnonzero(known), len(known))[first_known]
    some = at_known < w.first[1:]
    opening[some] = label[at_known[some]]
    return letters / np.maximum(total, 1)[:, None], opening, label


def labels_of(w: Words, m: Model, cells: int = CELLS, long_words: int = LONG_WORDS) -> np.ndarray:
    """The language of every word. Texts go in step, as many at once as `cells` scores allow; a longer text goes piece by piece."""
    label = np.zeros(len(w.start), dtype=np.int32)
    length = np.diff(w.first)
    for i in np.flatnonzero(length > long_words).tolist():
        label[w.first[i] : w.first[i + 1]] = long_viterbi(w, m, int(w.first[i]), int(w.first[i + 1]), long_words)
    begin = 0
    while begin < len(length):  # runs of short texts
        end, total = begin, 0
        while end < len(length) and length[end] <= long_words and (end == begin or total + length[end] * len(m.languages) <= cells):
            total += int(length[end]) * len(m.languages)
            end += 1
        if end > begin:
            x, y = int(w.first[begin]), int(w.first[end])
            label[x:y] = viterbi(word_scores(w, m, x, y), w.first[begin : end + 1] - x)
        begin = max(end, begin + 1)
    return label


def long_viterbi(w: Words, m: Model, a: int, b: int, piece: int, penalty: float = SWITCH) -> np.ndarray:
    """Labels of the words a to b of one text. The way there keeps the totals at the begin of each piece only; the way back makes a piece anew."""
    label = np.zeros(b - a, dtype=np.int32)
    k, saved = len(m.languages), []
    v = np.zeros(k, dtype=np.float32)
    for x in range(a, b, piece):
        saved.append(v)
        v = forward(word_scores(w, m, x, min(x + piece, b)), v, x == a, penalty)
    state = int(v.argmax())
    for n in range(len(saved) - 1, -1, -1):
        x = a + n * piece
        s = word_scores(w, m, x, min(x + piece, b))
        best, stays = np.zeros(len(s), dtype=np.int32), np.zeros((len(s), k), dtype=bool)
        forward(s, saved[n], n == 0, penalty, best, stays)
        for t in range(len(s) - 1, -1, -1):
            label[x - a + t] = state
            if n or t:
                state = state if stays[t, state] else int(best[t])
    return label


def forward(s: np.ndarray, v: np.ndarray, begins: bool, penalty: float, best: np.ndarray | None = None, stays: np.ndarray | None = None) -> np.ndarray:
    """Totals after the words of `s`, from those before; `best` and `stays` take the way back of each word."""
    penalty = np.float32(penalty)
    for t in range(len(s)):
        if begins and t == 0:
            v = s[0]
            continue
        arg = int(v.argmax())
        jump = v[arg] - penalty
        if stays is not None:
            best[t] = arg
            np.greater_equal(v, jump, out=stays[t])
        v = np.maximum(v, jump) + s[t]
    return v


def choose(shares: np.ndarray, opening: np.ndarray, bonus: float) -> np.ndarray:
    """The language of the largest share, the opening one with its bonus; of equal ones the opening language, then the first."""
    best = shares.argmax(axis=1)
    row = np.arange(len(shares))
    return np.where(shares[row, opening] + bonus >= shares[row, best], opening, best)


def opening_bonus(labelled: list[tuple[str | None, str]], m: Model) -> float:
    """The least bonus with which most labelled rows come out right; 0 unless EVIDENCE more do than without."""
    rows = [(t, x) for t, x in labelled if x is not None]
    if len(m.languages) < 2 or not rows:
        return 0.0
    right: dict[float, int] = {}
    grid = [k / 20 for k in range(20)]
    for a, b in slices([len(t or "") for t, _ in rows], 1 << 19):
        shares, opening, _ = shares_of(words_of([t for t, _ in rows[a:b]]), m, b - a)
        y = np.array([m.languages.index(x) for _, x in rows[a:b]])
        some = shares.sum(axis=1) > 0
        for g in grid:
            right[g] = right.get(g, 0) + int(((choose(shares, opening, g) == y) & some).sum())
    best = max(grid, key=lambda g: (right[g], -g))
    return best if right[best] >= right[0.0] + EVIDENCE else 0.0


def word_scores(w: Words, m: Model, a: int = 0, b: int | None = None, letters: int = LETTERS) -> np.ndarray:
    """(words a to b, languages): at most 0, the word's best language at 0; a language that does not use the word's script is at WORST.

    A word in a script that no language uses speaks for none. Letters are looked up some at a time, whatever the number of languages.
    """
    b = len(w.start) if b is None else b
    out = np.zeros((b - a, len(m.languages)), dtype=np.float32)
    size = (w.end - w.start)[a:b]
    for x, y in slices(size.tolist(), max(1, letters // max(1, len(m.languages)))):
        at = w.at[a + x : a + y]
        out[x:y] = np.add.reduceat(m.logp[w.trigram[at[0] : at[-1] + size[y - 1]]], at - at[0], axis=0)
    fits = m.uses[w.script[a:b]]
    narrowed = fits.any(axis=1)
    out[narrowed] = np.where(fits[narrowed], out[narrowed], np.float32(-1e9))
    out[~narrowed] = 0
    if len(out):
        out -= out.max(axis=1, keepdims=True)
    return np.maximum(out, np.float32(WORST))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of every word; `first` holds the first word of each text and the number of words. All texts go in step."""
    length = np.diff(first)
    labels = np.zeros(len(scores), dtype=np.int32)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    v = np.zeros((len(length), scores.shape[1]), dtype=np.float32)
    best_at: list[np.ndarray] = []
    stays: list[np.ndarray] = []
    for t in range(steps):
        n = active[t]
        s = scores[begin[:n] + t]
        if t == 0:
            v[:n] = s
            best_at.append(np.zeros(0, dtype=np.int64))
            stays.append(np.zeros((0, 0), dtype=bool))
            continue
        old = v[:n]
        arg = old.argmax(axis=1)
        jump = old[np.arange(n), arg] - np.float32(penalty)
        stay = old >= jump[:, None]
        v[:n] = np.where(stay, old, jump[:, None]) + s
        best_at.append(arg)
        stays.append(stay)
    state = v.argmax(axis=1) if steps else np.zeros(0, dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        labels[begin[:n] + t] = state[:n]
        if t:
            state[:n] = np.where(stays[t][np.arange(n), state[:n]], state[:n], best_at[t])
    return labels


def identify(texts: list[str | None], m: Model, spans: bool = False) -> dict[str, list]:
    """lang_pred, score (share of letters in spans of that language), and spans in code points if asked for."""
    if not m.languages:
        out: dict[str, list] = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        return out | ({"spans": [[] for _ in texts]} if spans else {})
    w = words_of(texts)
    first = w.first
    shares, opening, label = shares_of(w, m, len(texts))
    best = choose(shares, opening, m.bonus)
    share = shares[np.arange(len(texts)), best]
    out = {
        "lang_pred": [m.languages[k] if c else "und" for k, c in zip(best, np.diff(first), strict=True)],
        "score": share.tolist(),
    }
    if spans:
        out["spans"] = []
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            cut = [a, *(a + 1 + np.flatnonzero(np.diff(label[a:b]))), b] if b > a else []
            out["spans"].append(
                [
                    {"start": int(w.start[x] - w.offset[i]), "end": int(w.end[y - 1] - w.offset[i]), "lang": m.languages[label[x]]}
                    for x, y in zip(cut[:-1], cut[1:], strict=True)
                ]
            )
    return out


def labelled_sample(
    docs: DataFrame, use: Column, per_language: int, lang: str, text: str, id_col: str, max_languages: int = MAX_LANGUAGES
) -> list[tuple[str, str]]:
    """About `per_language` rows of each of the `max_languages` most frequent languages, by a hash of the id: bounded, the same on every run."""
    rows = docs.where(use & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(7)).alias("h")
    )
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return []
    keep = docs.sparkSession.createDataFrame([(r["lang"], int(1_000_000 * min(1.0, per_language / r["count"])) + 1) for r in counts], "lang string, below int")
    picked = rows.join(F.broadcast(keep), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("below")).limit(2 * per_language * len(counts)).collect()
    return [(r["text"], r["lang"]) for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["text"]))]


def identify_languages(
    docs: DataFrame,
    keep: list[str],
    learn_from: Column,
    per_language: int = PER_LANGUAGE,
    spans: bool = False,
    lang: str = "lang",
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Per row of `docs`: `keep` columns, lang_pred, score and, if asked for, spans (start, end, lang; code points).

    Learns from rows where `learn_from` holds and language and text are not
    null. Null texts and texts without letters are `und` with score 0; with nothing to learn from every text
    is. The score is the share of the letters in spans of the predicted language; letters of a script that
    no learned language uses are in no span, so a text of such letters has a learned language with score 0. Of equal shares the opening language wins. Repeated rows stay; an empty table gives an empty result.
    """
    model = train(labelled_sample(docs, learn_from, per_language, lang, text, id_col))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def kernel():
        def score(texts):
            out = identify(texts, model, spans)
            made = {"lang_pred": pa.array(out["lang_pred"], pa.string()), "score": pa.array(out["score"], pa.float64())}
            return made | ({"spans": pa.array(out["spans"], kind)} if spans else {})

        return score

    schema = "lang_pred string, score double" + (", spans array<struct<start: bigint, end: bigint, lang: string>>" if spans else "")
    return map_text(docs, keep, kernel, schema, text=text)
