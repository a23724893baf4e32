"""Language ID against a plain fusion of all rows, and its parsing of pages in linear time."""

import math
import random
import time

import numpy as np
import pytest

from chronoframe.llm import language
from chronoframe.llm.common import mix64

from .helpers import SCHEMA, clashing, table

PAGES = "page_id bigint, url string, html string"


def bucket(gram):
    code = np.array([gram[0] << 16 | gram[1] << 8 | gram[2]], np.uint64)
    return int(mix64(code)[0] % np.uint64(language.BUCKETS))


def grams(text):
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [bucket(folded[i : i + 3]) for i in range(len(folded) - 2)]


def fused(pages, docs):
    """Every page's posterior by loops over all rows."""
    labelled = [(t, k) for _, t, k, *_ in docs if k is not None]
    langs = sorted({k for _, k in labelled})
    counts = {k: {} for k in langs}
    for text, k in labelled:
        for g in grams(text):
            if k in counts:
                counts[k][g] = counts[k].get(g, 0) + 1
    total = {k: sum(counts[k].values()) + 0.5 * language.BUCKETS for k in langs}
    rows = []
    for page_id, url, html in pages:
        host = (url or "").partition("://")[2].partition("/")[0].rpartition("@")[2].partition(":")[0].lower() if "://" in (url or "") else ""
        own = grams(language.visible_text(html))
        ll = [language.TEMPER * sum(math.log((counts[k].get(g, 0) + 0.5) / total[k]) for g in own) for k in langs]
        p = np.exp(np.array(ll) - max(ll))
        rows.append((page_id, host, host.rpartition(".")[2], language.declared_language(html), ll, p / p.sum()))
    world = sum(r[5] for r in rows)
    kinds = len({r[3] for r in rows})
    out = {}
    for page_id, host, suffix, said, ll, p in rows:
        near = lambda at, value: sum(r[5] for r in rows if r[at] == value)  # noqa: E731,B023
        base = (world + 1) / (world.sum() + len(langs))
        of_suffix = np.maximum(sum(r[5] for r in rows if r[2] == suffix) - p, 0)
        of_suffix = (of_suffix + language.SUFFIX_WEIGHT * base) / (of_suffix.sum() + language.SUFFIX_WEIGHT)
        of_host = np.maximum(sum(r[5] for r in rows if (r[1], r[2]) == (host, suffix)) - p, 0)
        prior = (of_host + language.HOST_WEIGHT * of_suffix) / (of_host.sum() + language.HOST_WEIGHT)
        declared = (near(3, said) + language.DECLARED_WEIGHT) / (world + language.DECLARED_WEIGHT * kinds)
        z = np.array(ll) + np.log(declared) + np.log(prior)
        post = np.exp(z - z.max())
        out[page_id] = (host, said, langs[int(np.argmax(ll))], langs[int(np.argmax(z))], round(float((post / post.sum()).max()), 6))
    return out


def sample(seed=6, languages=5):
    rng = random.Random(seed)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 8))) for _ in range(30)] for k in range(languages)}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    names = sorted(words)
    docs = [(i, say(names[i % languages], 25), names[i % languages], "s", None) for i in range(6 * languages)]
    docs += [(9000, None, names[0], "s", None), (9001, "xyz", None, "s", None), (9002, "", names[0], "s", None)]
    pages = []
    for i in range(80):
        k = names[min(int(rng.expovariate(0.6)), languages - 1)]
        host = rng.choice(["a.example.com", "b.example.com", "WWW.Site.de", "user@c.org:80", "hot.net", "hot.net", "hot.net"])
        pages.append((i, f"https://{host}/{i}", f'<html lang="{rng.choice([k, k, names[0]])}"><p>{say(k, rng.randint(0, 6))} {say(names[0], rng.randint(0, 3))}</p>'))
    pages += [(100, None, None), (101, "", ""), (102, "http://hot.net/", None), (103, "no host", "<HTML LANG=de-AT>&amp;&#65;</html>"), (103, "http://hot.net/x", "ab"), (104, "http://x.y.z", "<p>unclosed < text")]
    return pages, docs


def test_language_is_plain_fusion(spark):
    pages, docs = sample()
    want = fused([p for p in pages if p[0] != 103], docs)
    unique = [p for p in pages if p[0] != 103]
    found = {r.page_id: r for r in language.identify(clashing(spark.createDataFrame(unique, PAGES)).repartition(3), clashing(table(spark, docs))).collect()}
    assert len(found) == len(unique)
    for i, (host, said, text_lang, lang, confidence) in want.items():
        r = found[i]
        assert (r.host, r.declared, r.lang) == (host, said, lang) and abs(r.confidence - confidence) < 2e-6, (i, r, want[i])
        assert r.text_lang == text_lang
    # repeated ids are rows of their own
    assert language.identify(spark.createDataFrame(pages, PAGES), table(spark, docs)).where("page_id = 103").count() == 2


def test_many_languages(spark):
    pages, docs = sample(3, 300)
    found = language.identify(spark.createDataFrame(pages[:40], PAGES), table(spark, docs)).collect()
    assert len(found) == 40 and len(language.languages(table(spark, docs))) == 300
    # a label of one document in 1,501 is a language
    some = [(i, "the and that", "en", "s", None) for i in range(1500)] + [(2000, "der die das", "rare", "s", None)]
    assert language.languages(table(spark, some)) == ["en", "rare"]
    page = [(i, None, text) for i, text in enumerate(["<p>the and that the and that</p>", "<p>der die das der die das der die das der die das</p>"])]
    assert {r.page_id: r.lang for r in language.identify(spark.createDataFrame(page, PAGES), table(spark, some)).collect()} == {0: "en", 1: "rare"}


def test_slices_of_languages(spark, monkeypatch):
    """By slices of languages, and sums by rows, results are those of all at once."""
    pages, docs = sample(4, 20)
    unique = [p for p in pages if p[0] != 103]
    whole = {r.page_id: r for r in language.identify(spark.createDataFrame(unique, PAGES), table(spark, docs)).collect()}
    monkeypatch.setattr(language, "SLICE", 7)
    found = {r.page_id: r for r in language.identify(spark.createDataFrame(unique, PAGES).repartition(3), table(spark, docs)).collect()}
    assert found.keys() == whole.keys()
    for i, r in found.items():
        assert (r.host, r.declared, r.text_lang, r.lang) == (whole[i].host, whole[i].declared, whole[i].text_lang, whole[i].lang) and abs(r.confidence - whole[i].confidence) < 2e-6


@pytest.mark.parametrize("page", ["<script>" * 125_000, "<html " * 170_000, "<" * 1_000_000, "<!--" * 250_000, "<html lang=" + " " * 1_000_000, "<html lang" * 100_000, "<script>" + "</script " * 110_000, "&#" + "9" * 1_000_000 + ";", "<a>" * 330_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    language.visible_text(page)
    language.declared_language(page)
    assert time.perf_counter() - start < 2


def test_visible_text():
    say = language.visible_text
    assert say("a<b>c</b><!-- <p> -->d") == "a c  d" and say("<SCRIPT x>var a='<p>'</script >e") == " e" and say("<script>never closed <p>f") == " never closed  f"
    assert say("<!-- open <p>g") == " g" and say("1 < 2") == "1 < 2" and say("&lt;&#65;&#x42;") == "<AB" and say(None) == "" and say("&#99999999999;") == "�"
    assert language.declared_language("<html><html lang='fra'>") == "fra" and language.declared_language("<html lang=engl>") == "" and language.declared_language("<html\nLANG = \"De\"") == "de"


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.identify(spark.createDataFrame([], PAGES), none).count() == 0
