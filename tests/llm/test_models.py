from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from plumbline.llm import html_extract, langid, quality, toxicity
from plumbline.llm.common import fold, slices


def test_slices_cover_everything():
    assert list(slices([3, 3, 9, 1, 1], 5)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert list(slices([], 5)) == []


# language identification


def test_viterbi_matches_all_paths():
    r = np.random.default_rng(2)
    for _ in range(30):
        lengths = r.integers(0, 6, 4)
        first = np.concatenate(([0], np.cumsum(lengths)))
        s = r.normal(size=(first[-1], 3)).astype(np.float32) * 3
        got = langid.viterbi(s, first, 1.5)
        for a, b in zip(first[:-1], first[1:], strict=True):
            worth = lambda p: sum(s[a + i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            best = max((worth(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert worth(tuple(got[a:b])) == pytest.approx(best, abs=1e-4)


def test_mixed_text_falls_into_spans():
    english = "the cat and the dog were there with them when they thought of this".split()
    german = "der hund und die katze schlafen nicht während sie über das wetter reden".split()
    russian = "это был длинный день".split()
    rows = [(" ".join(random.Random(i).choices(english, k=60)), "en") for i in range(20)]
    rows += [(" ".join(random.Random(i).choices(german, k=60)), "de") for i in range(20)] + [(" ".join(russian * 10), "ru")] * 5
    m = langid.train(rows)
    text = "12 " + " ".join(english) + " — " + " ".join(german * 2) + ". Δelta."
    long = " ".join(english[:4]) + " " + " ".join(german * 9)
    out = langid.identify([text, "", None, "123 !", "день", "漢字", long], m, spans=True)
    assert out["lang_pred"][:5] == ["de", "und", "und", "und", "ru"] and out["score"][1:4] == [0.0] * 3
    assert 0.5 < out["score"][0] < 0.9 and out["lang_pred"][6] == "de" and out["score"][6] > 0.8
    assert [s["lang"] for s in out["spans"][0]][:2] == ["en", "de"]
    a, b = out["spans"][0][:2]
    assert text[a["start"] : a["end"]] == " ".join(english) and text[b["start"] :].startswith("der hund")
    assert m.bonus == 0 and langid.identify(["\u0301\u0302 \u0303", "e\u0301 the cat"], m)["lang_pred"] == ["und", "en"]  # marks alone are no letters
    quoting = [(" ".join(random.Random(i).choices(english, k=20)) + " " + " ".join(random.Random(i).choices(german, k=45)), "en") for i in range(8)]
    named_by_opening = langid.train(rows + quoting)
    assert named_by_opening.bonus > 0.2
    for model, want in ((m, "de"), (named_by_opening, "en")):  # the same text, by what the labels of mixed texts say
        assert langid.identify([" ".join(english[:8]) + " " + " ".join(german[:12])], model)["lang_pred"] == [want]
    assert langid.identify(["abc"], langid.train([])) == {"lang_pred": ["und"], "score": [0.0]}


def test_language_id_over_spark(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify_languages(docs, ["doc_id", "lang"], fold("doc_id", 4) != 2).where(fold("doc_id", 4) == 2).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    odd = {r["doc_id"]: r for r in langid.identify_languages(odd_docs, ["doc_id"], fold("doc_id", 4) != 2).collect()}
    assert {i for i, r in odd.items() if r["lang_pred"] == "und"} == {2, 3, 4, 8}
    assert langid.identify_languages(no_docs, ["doc_id"], fold("doc_id", 4) != 2).count() == 0


# quality


def test_forward_backward_matches_all_labelings():
    r = np.random.default_rng(4)
    first = np.array([0, 1, 5, 8])
    u, a = r.normal(size=8), r.normal(size=(2, 2))
    p, pairs, logz = quality.forward_backward(u, a, first)
    total, seen = 0.0, np.zeros((2, 2))
    for b, e in zip(first[:-1], first[1:], strict=True):
        z, m = 0.0, np.zeros(e - b)
        t = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=e - b):
            w = np.exp(sum(u[b + i] * k for i, k in enumerate(y)) + sum(a[i, j] for i, j in zip(y, y[1:], strict=False)))
            z += w
            m += w * np.array(y)
            for i, j in zip(y, y[1:], strict=False):
                t[i, j] += w
        assert p[b:e] == pytest.approx(m / z)
        seen += t / z
        total += np.log(z)
    assert pairs == pytest.approx(seen) and logz == pytest.approx(total)


def held_out_scores(spark, sf, score, label, modulus, held):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, labels, ["doc_id"], fold("doc_id", modulus) != held).where(fold("doc_id", modulus) == held)
    rows = got.join(labels, "doc_id").select("score", label).collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_held_out_rows(spark, odd_docs, no_docs, no_labels):
    s, y = held_out_scores(spark, "/root/testdata/sf0.01", quality.score_quality, "quality", 5, 0)
    assert np.mean((s >= 0.3) == (y == 1)) >= 0.95 and s.min() >= 0 and s.max() <= 1
    labels = spark.createDataFrame([(1, 1, 0, "x"), (5, 0, 1, "x"), (5, None, None, "x"), (None, 1, 1, "x"), (77, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    assert len([r for r in quality.score_quality(odd_docs, labels, ["doc_id"], fold("doc_id", 5) >= 0, lines=True).collect() if 0 <= r["score"] <= 1]) == 11
    assert {r["score"] for r in quality.score_quality(odd_docs, no_labels, ["doc_id"], fold("doc_id", 5) != 0).collect()} == {0.5}
    assert quality.score_quality(no_docs, labels, ["doc_id"], fold("doc_id", 5) != 0).count() == 0


# toxicity


def test_windows_overlap_and_cover():
    for n in range(0, 200):
        start, length, _ = toxicity.windows_of(np.array([0, n]))
        covered = set(itertools.chain(*(range(a, a + k) for a, k in zip(start, length, strict=True))))
        assert covered == set(range(n))
        assert all(b < a + k for a, k, b in zip(start, length, start[1:], strict=False))


def test_backward_matches_finite_differences():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.tokens_of(["alpha beta gamma", "one two three four five six"])
    start, length, _ = toxicity.windows_of(t.first)
    x, mask, _ = toxicity.gather(net.inputs(t).astype(np.float64), start, length)
    loss = lambda z: float(z @ np.array([0.7, -1.3]))
    kept = net.forward(x, mask, keep=True)[1]
    d, dx = net.backward(x, mask, kept, np.array([0.7, -1.3]))
    step = 1e-2  # states are float32
    for name in ("wx", "u", "att", "out", "bx"):
        flat, grad = net.p[name].reshape(-1), d[name].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 7)):
            was = flat[i]
            flat[i] = was + step
            up = loss(net.forward(x, mask))
            flat[i] = was - step
            down = loss(net.forward(x, mask))
            flat[i] = was
            assert grad[i] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=0.05)


def plain_logit(net, words):
    """One window, one word and one gate at a time."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    x = [net.inputs(toxicity.tokens_of([w]))[0].astype(np.float64) for w in words]
    states = []
    for d in (0, 1):
        s, out = np.zeros(h), []
        for v in x if d == 0 else x[::-1]:
            i, u = v @ p["wx"][d] + p["bx"][d][0], s @ p["u"][d]
            z, r = sig(i[:h] + u[:h]), sig(i[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * np.tanh(i[2 * h :] + r * u[2 * h :]) + z * s
            out.append(s)
        states.append(out if d == 0 else out[::-1])
    score = np.array([states[0][k] @ p["att"][0] + states[1][k] @ p["att"][1] for k in range(len(words))])
    a = np.exp(score - score.max())
    a /= a.sum()
    pooled = [sum(a[k] * states[d][k] for k in range(len(words))) for d in (0, 1)]
    return float(pooled[0] @ p["out"][0] + pooled[1] @ p["out"][1] + p["bias"][0])


def test_scores_match_the_plain_network():
    """Whole texts: every overlapping window on its own, the highest counts."""
    r = random.Random(12)
    net = toxicity.Network(4)
    net.p = {k: (v * 5 if k in ("word", "gram", "prefix") else v) for k, v in net.p.items()}
    net.slope, net.shift = 1.3, -0.2
    word = lambda: "".join(r.choice("aeiouéñß漢x1") for _ in range(r.randint(1, 9)))
    texts = [[word() for _ in range(n)] for n in (1, 5, 31, 32, 33, 56, 57, 130)]
    got = toxicity.score_texts(net, [" ".join(t) for t in texts])
    for t, s in zip(texts, got, strict=True):
        starts = range(0, max(1, -(-(len(t) - toxicity.WINDOW) // toxicity.STRIDE) * toxicity.STRIDE + 1), toxicity.STRIDE)
        z = max(plain_logit(net, t[a : a + toxicity.WINDOW]) for a in starts)
        assert s == pytest.approx(1 / (1 + np.exp(-(1.3 * z - 0.2))), abs=1e-4)


def test_long_texts_are_scored_in_runs_of_windows():
    r = random.Random(13)
    net = toxicity.Network(6)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n)) for n in (3, 40, 400, 3000)] + ["x" * 5000, "- " * 3000 + "end", " ".join(["y" * 900] * 40)]
    whole = toxicity.score_texts(net, texts)
    for chunk in (50, 333, 4000):
        assert toxicity.score_texts(net, texts, chunk) == pytest.approx(whole, abs=1e-6)


def test_toxicity_finds_planted_words(spark, odd_docs, no_docs, no_labels):
    r = random.Random(8)
    calm = ["".join(r.choice("aeiourstnlm") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda bad: " ".join(r.choice(calm) if not bad or r.random() > 0.05 else r.choice(["grobian", "wretch", "FIEND!"]) for _ in range(r.randint(40, 150)))
    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    net = toxicity.train(rows[:200], 1 / 3)
    s = toxicity.score_texts(net, [t for t, _ in rows[200:]] + [None, "", "---"])
    y = np.array([y for _, y in rows[200:]])
    assert np.mean((s[:-3] >= 0.3) == (y == 1)) >= 0.95 and (s[-3:] < 0.3).all()
    assert {round(x["score"], 6) for x in toxicity.score_toxicity(odd_docs, no_labels, ["doc_id"], fold("doc_id", 4) != 2).collect()} == {0.047426}
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (None, 1, "x"), (9, None, "x")], "doc_id long, toxic int, score string")
    assert len([x for x in toxicity.score_toxicity(odd_docs, labels, ["doc_id"], fold("doc_id", 4) >= 0).collect() if 0 <= x["score"] <= 1]) == 11
    assert toxicity.score_toxicity(no_docs, labels, ["doc_id"], fold("doc_id", 4) >= 0).count() == 0


# HTML


@pytest.fixture(scope="module")
def html_model():
    return html_extract.trained()


def test_sum_product_matches_all_labelings():
    r = np.random.default_rng(6)
    tree = html_extract.parse("<div><p>a<b>c</b></p><ul><li>x</ul></div>")
    f, _ = html_extract.forest([tree])
    n = len(tree.tag)
    u, a = r.normal(size=n), r.normal(size=(2, 2, 2))
    p, pairs = html_extract.sum_product(f, u, a)
    z, m, seen = 0.0, np.zeros(n), np.zeros((2, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(a[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, n)))
        z += w
        m += w * np.array(y)
        for i in range(1, n):
            seen[f.kind[i], y[f.parent[i]], y[i]] += w
    assert p == pytest.approx(m / z) and pairs == pytest.approx(seen / z)


def test_parser_takes_any_text():
    p = html_extract.parse
    assert p("<p>a<p>b").parent == [-1, 0, 0]
    assert p("<p><b>a<br><p>b</p>").tag == ["#root", "p", "b", "br", "p"]
    assert p('<a title="1 > 0" class=x>t</a>').tag == ["#root", "a"]
    assert [s for _, s in p("x &amp; y &lt; &#233;").pieces] == ["x & y < é"]
    assert p('<script>var t="</p>";</script>z').tag == ["#root", "script"]
    for odd in (None, "", "<", "a < b", "<p", "<!-- x", "</p></div>", "<p " + "x" * 10, "&am", "<a b='", "<![CDATA[x]]>"):
        p(odd)


def test_extraction_on_unseen_pages(html_model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="masthead"><a href="/">Home</a></header>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head&nbsp;line &amp; more</h1><p>First  para <b>bold</b>face.<p>Second&#33;<div class="ad">Buy now</div><p>Third</p></article>
    <section class="comments"><p>Nice post</p></section><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""
    got = html_extract.extract([page, None, "", "plain words", "<nav><a href=x>menu</a></nav>"], html_model)
    assert got == ["Head line & more First para boldface. Second! Third", "", "", "plain words", ""]
    pages = html_extract.labelled_pages(140, seed=77)
    f, _ = html_extract.forest([html_extract.parse(h) for h, _ in pages])
    p, _ = html_extract.sum_product(f, f.x @ html_model.w, html_model.a)
    assert np.mean((p > 0.5) == np.concatenate([y for _, y in pages])) >= 0.98


def main_text(page, flags):
    """The text of the flagged elements."""
    return html_extract.SPACE.sub(" ", "".join(" " if s is None else s for e, s in html_extract.parse(page).pieces if s is None or flags[e])).strip()


@pytest.mark.parametrize("markup,least", [("neutral", 0.9), ("nested", 0.9), ("body", 0.9), ("table", 0.85), ("bare", 0.9), ("plain", 1.0), ("named", 0.7)])
def test_extraction_of_markups_never_trained_on(markup, least):
    model = html_extract.train(html_extract.labelled_pages(400, 5, tuple(k for k in html_extract.MARKUPS if k != markup)))
    pages = html_extract.labelled_pages(60, 98, (markup,))
    got = html_extract.extract([h for h, _ in pages], model)
    assert np.mean([g == main_text(h, y) for g, (h, y) in zip(got, pages, strict=True)]) >= least


def test_extraction_of_common_layouts(html_model):
    say = "The quick brown fox jumps over the lazy dog near the river bank today, and then it goes home."
    body = f"<h1>Title</h1><p>{say}</p><p>{say} {say}</p>"
    layouts = [
        f"<div>{body}</div>", f"<section>{body}</section>", f'<div id="content">{body}</div>', f"<div><div><div>{body}</div></div></div>", f"<nav><a href=x>Home</a></nav>{body}<footer>x 2020</footer>", body,
        f"<table><tr><td><a href=x>Home</a><a href=y>News</a></td><td>{body}</td></tr></table>", f"<article>{body}</article><h3>3 replies</h3><p>nice post</p>",
        f"<article>{body}<svg><text>label</text></svg></article>",
    ]
    got = html_extract.extract([f"<html><body>{x}</body></html>" for x in layouts] + [say], html_model)
    assert got == [f"Title {say} {say} {say}"] * len(layouts) + [say]


def test_hostile_pages_are_parsed_in_linear_time():
    import time

    for part in ("<a ", "<", "<!--", '<a "', "<a b='", "<p>", "<li><b>", "</", "<table><td>", "<x a=\"'"):
        for n in (20_000, 80_000):
            began = time.process_time()
            html_extract.parse(part * n + "</p>" * n)
            took = time.process_time() - began
            if n == 20_000:
                first = took
        assert took < 8 * first + 0.5, part


def test_query_equals_the_plain_way(spark, tmp_path, html_model):
    """Whole queries against marginals by enumeration of all labelings, on pages of few elements."""
    from plumbline.llm.queries import op1_html_extraction

    pages = ["<div><p>one two</p><a href=x>m</a></div>", "<article>x&amp;y<br>z</article><nav>n</nav>", "a  b\n c", None, "", "<h1>T</h1><p>p<b>q</b></p><footer>f</footer>"]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op1_html_extraction(spark, str(tmp_path)).collect()}
    for i, h in enumerate(pages):
        tree = html_extract.parse(h)
        x, n = html_extract.features(tree), len(tree.tag)
        u, a = x @ html_model.w, html_model.a
        weight = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u[e] * y[e] for e in range(n)) + sum(a[int(tree.tag[e] in html_extract.BLOCKS), y[tree.parent[e]], y[e]] for e in range(1, n)))
            weight[range(n), y] += w
        text = main_text(h, weight[:, 1] > weight[:, 0])
        assert got[i] == (text, len(text))


def test_extraction_over_spark(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html_extract.extract_main_text(pages, ["page_id"]).collect()
    assert len(rows) == pages.count() and all(r["main_text"] for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "<article><p>" + "a b " * 100_000, "x")], "page_id int, html string, main_text string")
    assert sorted(len(r["main_text"]) for r in html_extract.extract_main_text(odd, ["page_id"]).collect()) == [0, 0, 0, 399_999]
    assert html_extract.extract_main_text(odd.limit(0), ["page_id"]).count() == 0
