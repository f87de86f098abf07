import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe, html_blocks, language_id, license_scan, queries, secret_scan, toxicity
from marlstone.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, score double, n_words string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0.0, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)


ODD = [None, "", " ", "a", "a\x1cb \x1d c", "  x　y", "aaaa aaaaaaa", "<|endoftext|>hi <|endoftext|>", "it's we're 12³½Ⅷ", "日本語 😀😀 ñ́", "\n\n\n x\n \t\n", "a \n \nb", " <|endoftext|> x", "ab" * 30_000, "w " * 20_000, "\x00\x01\x7f\U0010ffff", "a   b c  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_against_the_library(spark, library):
    got = {r.doc_id: r for r in bpe.tokenized(frame(spark, ODD + ODD), queries.vocabulary(), with_tokens=True).collect()}
    for i, t in enumerate(ODD + ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r.token_ids == ids and r.decoded == text and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenized(frame(spark, ODD).where("false"), queries.vocabulary()).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\tab'<|>"), max_size=60), max_size=4))
def test_bpe_on_any_text(texts):
    from tokenizers import Tokenizer

    v = test_bpe_on_any_text.__dict__.setdefault("v", (bpe.Vocabulary.read(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())))
    for packed, t in zip(bpe.Encoder(v[0]).encode(texts), texts, strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == v[1].encode(t, add_special_tokens=False).ids
        assert bpe.decode_ids(packed, v[0]) == t


def plain_statistics(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t  #|\x0b\x1c"), max_size=80))
def test_quality_statistics(t):
    assert Q.statistics(t)[:5] == plain_statistics(t)


def test_quality_verdicts(spark):
    good = ["plain words that say something new number %d and go on %d " % (i, i) + " ".join(f"w{i}x{j}" for j in range(80)) for i in range(60)]
    bad = [" ".join(f"w{i}y{j}$$$" for j in range(80)) for i in range(40)]
    texts = good + bad + [None, "", "same line\n" * 40, "x" * 100_000]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(60 + i, 0) for i in range(30)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality_verdicts(frame(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = plain_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 104))
    none = labels.where("false")
    assert [r.kept for r in Q.quality_verdicts(frame(spark, [bad[0]]), none).collect()] == [True]
    assert Q.quality_verdicts(frame(spark, ["x"]).where("false"), labels).count() == 0
    kept = Q.keep_good(frame(spark, texts), labels)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ") and kept.count() == 60


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", "mit\n\tLICENSE MIT-license", "Licensed under the Apache Licence, Version 2.0", "This work is licenced under the GNU General Public License, version 3",
        "Licensed under CC BY-NC 4.0.", "xmit license", "mit licenseé", None, "", "all right reserved", "nothing here " * 20_000 + "mit license", "general public license general public license",
    ]
    got = {r.doc_id: r for r in license_scan.license_spans(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, label) for phrase, label in license_scan.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [got[i].labels for i in (2, 3, 4, 9, 5, 6)] == ["apache", "gpl", "cc-by-nc", "all-rights-reserved", "", ""]
    assert got[2].spans[0].edits == 1 and 0.9 < got[2].score < 1 and (got[2].spans[0].first_word, got[2].spans[0].last_word) == (0, 7)
    assert got[4].score == 1.0 and got[8].score == 0.0


def test_license_seeds_miss_nothing():
    scanner, rng = license_scan.Scanner(), np.random.default_rng(0)
    for which, (notice, label) in enumerate(scanner.notices):
        for _ in range(10):
            t = list(notice)
            for _ in range(scanner.edits[which]):
                t[int(rng.integers(1, len(t) - 1))] = "q"
            found = [f for f in scanner.notices_in("some words " + "".join(t) + " more words")]
            assert any(f[0] == label or f[3] <= scanner.edits[which] for f in found), (notice, "".join(t))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity(spark, sf):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 400, n))
    toxic = rng.random(600) < 0.2
    texts = [say(60) + (" you awful fool " + say(5) + " vile thing" if y else "") for y in toxic] + [None, "", "fool " * 50_000]
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, texts), labels).collect()}
    assert all(got[i].held_out == held(i) for i in got) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    test = [i for i in range(600) if held(i)]
    assert sum(got[i].predicted == toxic[i] for i in test) / len(test) > 0.97
    assert got[600].score == got[601].score
    again = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, texts).repartition(5), labels).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    assert toxicity.toxicity(frame(spark, ["x"]).where("false"), labels.where("false")).count() == 0


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 !", "en", "s", 0), (10**6 + 2, "the and of " * 30_000, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(extra)
    got = {r.doc_id: r for r in language_id.languages(both).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    test = [r for r in rows if held(r.doc_id) and len(r.text) > 200]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in test) / len(test) > 0.95
    assert got[10**6].lang_pred == got[10**6 + 1].lang_pred == "und" and got[10**6 + 2].lang_pred == "en"
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert language_id.languages(both.where("false")).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    s, move, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight = {p: np.exp(start[p[0]] + sum(s[0, t, p[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))) for p in itertools.product(range(3), repeat=4)}
    z = sum(weight.values())
    p, log_z, moved = language_id.marginals(s, np.array([4]), move, start, pairs=True)
    assert abs(log_z[0] - np.log(z)) < 1e-9
    for t in range(4):
        for k in range(3):
            assert abs(p[0, t, k] - sum(w for q, w in weight.items() if q[t] == k) / z) < 1e-9
    for a in range(3):
        for b in range(3):
            assert abs(moved[a, b] - sum(w * sum(x == (a, b) for x in zip(q, q[1:], strict=False)) for q, w in weight.items()) / z) < 1e-9


def test_secrets(spark, sf):
    key, digest = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [f'the token = "{key}" here', f"see commit {digest} for it", "password = changeme123 and password: hunter_two_hunter", "AKIA" + "ABCDEFGH12345678", None, "", "plain words only", "x" * 200_000]
    got = secret_scan.secrets(frame(spark, texts * 3)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id % 8, []).append(r)
    assert len(by[0]) == 3 and by[0][0].is_secret and by[0][0].value_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert texts[0][by[0][0].start : by[0][0].end] == key
    assert not by[1][0].is_secret and by[3][0].is_secret and by[3][0].kind == "aws"
    assert not {4, 5, 6, 7} & set(by)
    assert secret_scan.secrets(frame(spark, texts).where("false")).count() == 0


def test_forest_learns():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    f = secret_scan.grow_forest(x[:300], y[:300])
    assert ((f.score(x[300:]) >= 0.5) == y[300:]).mean() > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy  now</div>
<article><h1>A &amp; B</h1><p><b>One two</b> thr<i>ee</i>.<br>Four<p>Five &lt;six&gt;</p><form><input>Mail</form></article>
<section id="comments"><p>nice</p></section><footer>&copy; me</footer></body></html>"""


def test_blocks():
    got = [(b.path[-1], b.text) for b in html_blocks.blocks_of(PAGE)]
    assert got == [("li", "Home"), ("class:ad", "Buy now"), ("h1", "A & B"), ("p", "One two three."), ("p", "Four"), ("p", "Five <six>"), ("form", "Mail"), ("p", "nice"), ("footer", "© me")]
    assert html_blocks.blocks_of(None) == html_blocks.blocks_of("") == html_blocks.blocks_of("<script>x") == [] and [b.text for b in html_blocks.blocks_of("a < b")] == ["a < b"]


def test_gradients_are_right():
    c = html_blocks.composed(["one two three four five six"], 3)
    pages = [html_blocks.vectors(b) for b, _ in c]
    labels = [y for _, y in c]
    m = html_blocks.Labeller.new()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    real = sum(map(len, labels))

    def loss():
        return -sum((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() for p, y in zip(m.forward(pages), labels, strict=True)) / real

    g = m.gradients(pages, labels)
    rng = np.random.default_rng(0)
    for k in m.w:
        flat = np.flatnonzero(g[k])
        for at in rng.choice(flat, 3):
            old, eps = m.w[k].flat[at], 1e-2
            m.w[k].flat[at] = old + eps
            up = loss()
            m.w[k].flat[at] = old - eps
            down = loss()
            m.w[k].flat[at] = old
            assert abs((up - down) / (2 * eps) - g[k].flat[at]) < 2e-3 + 0.05 * abs(g[k].flat[at]), k


def test_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", ""), (10**6 + 2, "u", PAGE), (10**6 + 3, "u", "<article>" + "<p>many words here.</p>" * 5000 + "</article>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_blocks.extract(pages.unionByName(extra).withColumn("text", html_col())).collect()}
    assert got[10**6].text == got[10**6 + 1].text == "" and got[10**6 + 2].text == "A & B One two three. Four Five <six>"
    assert got[10**6 + 3].n_chars == 5000 * 17 - 1
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)
        if inner:
            parts = re.split(r"</?(?:p|h1|br)>", inner[1])
            want = " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts if x.strip())
            assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def html_col():
    from pyspark.sql import functions as F

    return F.lit("a clashing column")
