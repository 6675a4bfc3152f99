"""Language identification against a plain version, unlearned scripts, many languages and long texts."""

from __future__ import annotations

import random
import tracemalloc
import unicodedata

import numpy as np
import pytest

from plumbline.llm import langid
from plumbline.llm.langid import BUCKET_BITS, SCRIPT_RANGES, SWITCH, USES_SCRIPT, WORST, identify, identify_languages, labels_of, train, words_of

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and runs into the woods with all the others", "de": "der schnelle braune fuchs springt über den faulen hund und läuft in den wald hinein", "el": "η γρήγορη αλεπού πηδά πάνω από το τεμπέλικο σκυλί"}


def model():
    return train([(t, lang) for lang, t in TEXTS.items() for _ in range(3)])


def plain(text, m):
    """Words, trigram scores and spans by loops over characters; by the same tables of the model."""
    kind = lambda c: "L" if unicodedata.category(c)[0] == "L" else "M" if unicodedata.category(c)[0] == "M" else ""
    low = lambda c: c.lower() if len(c.lower()) == 1 and unicodedata.category(c) in ("Lu", "Lt") else c
    words, now = [], ""
    for c in text + " ":
        if kind(c):
            now += c
        else:
            if any(kind(x) == "L" for x in now):
                words.append(now)
            now = ""
    scores, known, size = [], [], []
    for w in words:
        codes = [0, *(ord(low(c)) for c in w), 0]
        s = np.zeros(len(m.languages))
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32
            s += m.logp[h >> (32 - BUCKET_BITS)]
        first = ord(next(c for c in w if kind(c) == "L"))
        fits = m.uses[[k for a, k in SCRIPT_RANGES if a <= first][-1]]
        s = np.where(fits, s, -1e9) if fits.any() else s * 0
        scores.append(np.maximum(s - s.max(), WORST))
        known.append(fits.any())
        size.append(len(w))
    if not words:
        return "und", 0.0
    v, back = scores[0], []
    for s in scores[1:]:
        jump = v.max() - SWITCH
        back.append((v >= jump, int(v.argmax())))
        v = np.maximum(v, jump) + s
    state, label = int(v.argmax()), [0] * len(words)
    for t in range(len(words) - 1, -1, -1):
        label[t] = state
        if t and not back[t - 1][0][state]:
            state = back[t - 1][1]
    shares = np.zeros(len(m.languages))
    for x, n, k in zip(label, size, known, strict=True):
        shares[x] += n * k
    shares /= sum(size)
    opening = next((x for x, k in zip(label, known, strict=True) if k), 0)
    best = int(shares.argmax())
    best = opening if shares[opening] + m.bonus >= shares[best] else best
    return m.languages[best], shares[best]


def random_texts(n=150):
    r = random.Random(4)
    pool = [w for t in TEXTS.values() for w in t.split()] + ["Straße", "été", "漢字", "ไทย", "слово", "12", "--", "áb", "Ω", "́", "I"]
    return ["".join(r.choice([" ", ", ", "\n", ""]) + r.choice(pool) for _ in range(r.choice([0, 1, 3, 30]))) for _ in range(n)]


def test_whole_results_against_loops():
    m = model()
    texts = random_texts()
    got = identify(texts, m)
    for t, lang, score in zip(texts, got["lang_pred"], got["score"], strict=True):
        want = plain(t, m)
        assert (lang, round(score, 6)) == (want[0], round(want[1], 6)), t


def test_scripts_that_no_language_uses():
    """Letters of such scripts count among all, for no language: the share is low and never 1."""
    m = train([(TEXTS["en"], "en"), (TEXTS["de"], "de"), ("el perro corre por el bosque y salta", "es")])
    got = identify(["ภาษาไทย ภาษาไทย", "これは日本語です", "это русский текст", "the dog runs это русский", None, "12"], m)
    assert got["score"][:3] == [0.0, 0.0, 0.0] and got["lang_pred"][3] == "en" and 0 < got["score"][3] < 0.6
    assert all(x in ("de", "en", "es") for x in got["lang_pred"][:4]) and got["lang_pred"][4:] == ["und", "und"]


@pytest.mark.parametrize(("cells", "long_words"), [(64, 7), (1 << 20, 5), (10, 1000), (1 << 23, 20_000)])
def test_pieces_give_the_same_labels(cells, long_words):
    m = model()
    w = words_of([*random_texts(40), TEXTS["en"] + " " + TEXTS["de"] * 3 + " " + TEXTS["el"]])
    assert labels_of(w, m, cells, long_words).tolist() == labels_of(w, m, 1 << 30, 1 << 30).tolist()


def test_many_languages_and_a_long_text_in_bounded_memory():
    r = random.Random(2)
    made = lambda k: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz"[k % 13 :][:9]) for _ in range(r.randint(2, 8))) for _ in range(60))
    m = train([(made(k), f"l{k:03d}") for k in range(128)])
    text = (TEXTS["en"] + " ") * 25_000  # 2 MB, 400,000 words
    tracemalloc.start()
    got = identify([text], m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["score"][0] > 0 and peak < 200 * len(text), peak / len(text)


def test_uses_of_a_script():
    m = model()
    assert USES_SCRIPT > 0 and m.uses[2].tolist() == [x == "el" for x in m.languages]
    assert langid.EVIDENCE == 3


def test_odd_rows(spark, odd_docs):
    rows = identify_languages(odd_docs, ["doc_id"], learn_from=odd_docs["lang"].isNotNull()).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
