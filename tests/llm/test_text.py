"""Decontamination, HTML extraction, URL filters and language ID."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, fm_index, html_text, lang_id, url_filter


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(0)
    for k in range(80):
        n, docs = int(rng.integers(1, 200)), int(rng.integers(1, 8))
        w = rng.integers(1, int(rng.integers(2, 6)), n) if k % 3 else np.ones(n, np.int64)
        ends = np.sort(np.append(rng.integers(0, n + 1, docs - 1), n))
        index = fm_index.FMIndex(w, ends)
        parts = [w[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        for _ in range(6):
            size = int(rng.integers(1, 5))
            p = rng.integers(1, 6, size)
            phrase = np.full((1, 5), -1)
            phrase[0, 5 - size :] = [x if x <= w.max() else -1 for x in p]
            lo, hi = index.search(phrase, np.array([size]))
            got = sorted(zip(*[a.tolist() for a in index.place(index.locate(np.arange(lo[0], hi[0])))]))
            assert got == sorted((i, j) for i, d in enumerate(parts) for j in range(len(d) - size + 1) if d[j : j + size] == p.tolist())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(docs, items):
    wins = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - 13, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).update([str(name)] if name is not None else [])
    out = []
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for win, of in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    names |= of
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 24, 60])
def test_decontamination_messy(spark, messy, no_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "blocks", lambda *a, f=decontaminate.blocks: f(*a, limit=limit))
    items = [(1, "Seven WISE owls watch from the old oak tree near the river bank tonight!"), (2, "kappa"), (2, "theta iota"), (None, "beta gamma"), (3, None), (4, " ?! "), (10, "and3 word5 naïve"), (11, "word0 and0 word1 and1")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.judged(decontaminate.decontaminate(messy, benchmark))
    out = found.select("row.doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256), "contaminated")
    docs = [tuple(r) for r in messy.select("doc_id", "text").collect() if len(r.text or "") < 10_000]
    short = [tuple([str(r[0]), *r[1:]]) for r in out.where("n_words < 10000").collect()]
    assert sorted(short) == brute_contamination(docs, items)
    clean = decontaminate.clean_rows(messy, benchmark)
    assert clean.columns == messy.columns and {1, 2} & {r.doc_id for r in clean.collect()} == set()
    assert decontaminate.decontaminate(no_docs, benchmark).count() == 0
    none = decontaminate.judged(decontaminate.decontaminate(messy, benchmark.where("false")))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == 15


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header><h2>Site name</h2></header>
{article}<aside>Side words here</aside><div id="comments"><p>A reader says a lot of things in a very long comment about nothing at all.</p></div>
<form><p>Sign up</p></form><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="entry"><div>{}</div></div>', "<main><section>{}</section></main>"])
def test_main_text_of_layouts(wrap):
    body = "<h1>A &amp; B</h1><p>First  paragraph with <b>bold\n words</b> and <a href='x'>a link</a>, long enough to count as text.</p><!-- no --><div class='ad'>Buy now</div><p>Second paragraph &lt;ok&gt;, also of a fair length so that it is dense.<p>Third one without an end tag, which is as long as the others are."
    text = html_text.main_text(PAGE.format(article=wrap.format(body)))
    assert text.split("\n") == ["A & B", "First paragraph with bold words and a link, long enough to count as text.", "Second paragraph <ok>, also of a fair length so that it is dense.", "Third one without an end tag, which is as long as the others are."]


def test_main_text_of_several_sections():
    long, short = ["x" * 400 + f" {n}" for n in range(5)], ["y" * 80 + f" {n}" for n in range(3)]
    first, second = ("".join(f"<p>{x}</p>" for x in part) for part in (long, short))
    links = '<div><a href="/1">Another page</a> | <a href="/2">One more page</a></div><ul><li><a href="/3">A third page</a></li></ul>'
    page = f"<html><body>{links}<h1>Outer title</h1><div>{first}</div><h2><a href='#s'>Linked heading</a></h2><div><section>{second}</section>{links}</div>Bare text with <a href='/4'>a link</a> in it<p>End.</p></body></html>"
    assert html_text.main_text(page).split("\n") == ["Outer title", *long, "Linked heading", *short, "Bare text with a link in it", "End."]
    alone = f"<body><h1>Outside</h1><article><h2>Inside</h2>{first}</article><div>{second}</div></body>"
    assert html_text.main_text(alone).split("\n") == ["Inside", *long]


@pytest.mark.parametrize("page", [None, "", "<", "<!--", "<script>x", "plain words", "<p>", "</p></div>", "<div " * 50, "<b><i></b></i>", "<p>&am</p>", "<html><body></body></html>", "<div>" * 3000 + "deep" + "</div>" * 3000])
def test_odd_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    extra = pages.limit(1).selectExpr("CAST(NULL AS BIGINT) page_id", "CAST(NULL AS STRING) url", "CAST(NULL AS STRING) html")
    out = html_text.extract(pages.union(extra).withColumn("text", F.lit("clash"))).collect()
    assert len(out) == pages.count() + 1
    source = {r.page_id: r.html for r in pages.collect()}
    for r in out:
        assert r.n_chars == len(r.text)
        if r.page_id is not None:
            title = re.search(r"<h1>(.*?)</h1>", source[r.page_id], re.S)[1]
            assert r.text.split("\n")[0] == " ".join(html_text.html.unescape(title).split()) and "track(" not in r.text
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", ["class='search-theory'", "id='copyright-law'", "class='search'", "class='social-history menu-of-the-day'"])
def test_no_article_is_lost_to_a_name(name):
    body = "<p>" + "Words of the article go on. " * 20 + "</p><p class='social'>A last line.</p>"
    page = f"<body><div class='nav menu'>Some links</div><div {name}>{body}</div><div class='cookie-notice'>We use them.</div></body>"
    assert html_text.main_text(page).split("\n") == [("Words of the article go on. " * 20).strip(), "A last line."]
    assert html_text.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>") == "So x=1 holds."


PARAGRAPH = "Some words of a paragraph that go on and on for a while here."


@pytest.mark.parametrize("core", ["article", "div", "main"])
def test_menus_inside_the_core_go(core):
    menu = "<ul><li><a href='/1'>Menu one</a></li><li><a href='/2'>Menu two</a></li></ul><div><a href='/3'>Next</a> <a href='/4'>Last</a></div>"
    links = "<ul><li><a href='/5'>One link</a> with words of its own beside it.</li><li>And a point without any.</li></ul>"
    page = f"<body><{core}>{f'<p>{PARAGRAPH}</p>' * 3}{menu}{links}<p><a href='/6'>{PARAGRAPH}</a></p></{core}></body>"
    assert html_text.main_text(page).split("\n") == [PARAGRAPH] * 3 + ["One link with words of its own beside it.", "And a point without any.", PARAGRAPH]


def test_a_name_empties_no_page():
    body = f"<p>{PARAGRAPH}</p>" * 3
    assert html_text.main_text(f"<body><div class='related'>{body}</div></body>").split("\n") == [PARAGRAPH] * 3
    assert html_text.main_text(f"<body><div><p>A short article.</p></div><div class='comments'>{body}</div></body>") == "A short article."
    assert html_text.main_text(f"<body><article><p>A.</p></article><div class='related'>{body}</div></body>") == "A."


@pytest.mark.parametrize("page", ["<a " * 20_000, '<a "b>"' * 20_000, "<br" * 30_000, "</script" * 20_000, "<a '>" * 20_001, "<" * 100_000, "<div>" * 10_000 + "</foo>" * 10_000, "<span>" * 10_000 + "<p>x</p>" * 10_000, "<p>" + "long text " * 500_000])
def test_hostile_and_large_pages_take_linear_time(page):
    import time

    began = time.time()
    assert isinstance(html_text.main_text(page), str)
    assert time.time() - began < 5


URLS = [
    ("https://A.Example.COM/fr/1?x#y", "a.example.com", "/fr/1", "com/", "allow"),
    ("http://example.com/en/2", "example.com", "/en/2", "example.com/en/", "block"),
    ("http://blog.example.com/en/2", "blog.example.com", "/en/2", "example.com/en/", "block"),
    ("http://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
    ("http://net/fr/1", "net", "/fr/1", "net/fr/", "block"),
    ("http://notcom/en/", "notcom", "/en/", None, "allow"),
    ("http://examplecom.org", "examplecom.org", "", None, "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://h.org?q=/x", "h.org", "", None, "allow"),
    ("mailto:x", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://blog.free-casino-bets.example.org/en/1", "blog.free-casino-bets.example.org", "/en/1", None, "block"),
]


def test_url_rules_and_model(spark):
    pages = spark.createDataFrame([(n, u[0], "clash", "clash") for n, u in enumerate(URLS)], "page_id int, url string, host string, rule string")
    labelled = [(u, 1) for u in url_filter.BLOCKED] + [(u, 0) for u in url_filter.ALLOWED]
    out = url_filter.judge(pages, url_filter.RULES, labelled).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [u[1:] for u in URLS]
    assert all((r.p_block is None) == (r.rule is not None) for r in out)
    assert url_filter.judge(pages.where("false"), url_filter.RULES, labelled).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, [], []).collect()} == {"allow"}


def test_url_model_on_urls_it_never_saw(spark, small):
    """Hosts of the pages table that no rule fits: those named after spam are blocked, no other is."""
    out = url_filter.query(spark, small.replace("sf0.001", "sf0.01")).where("rule IS NULL").collect()
    spam = re.compile("spam|casino|pills|bets|adult|ads-track")
    assert any(spam.search(r.host) for r in out)
    assert all((r.verdict == "block") == bool(spam.search(r.host)) for r in out)


def test_url_model_from_a_labelled_table(spark):
    """Labels from a table; its threshold, precision and recall come from hosts that no model saw."""
    rng = np.random.default_rng(6)
    bad, good, places = ["casino", "pills", "bets", "loans"], ["garden", "museum", "library", "school"], ["play", "news", "shop", "read"]
    rows = [(f"http://{rng.choice(bad if n % 2 else good)}-{n}.example/{rng.choice(places)}/{n % 9}", n % 2) for n in range(240)]
    odd = [(None, 1), ("http://x.example/", None), ("http://y.example/", 7), ("no scheme", 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "link string, block int").repartition(3)
    labelled = url_filter.labelled_rows(df, "link", "block")
    assert sorted(labelled) == sorted([*set(rows), ("no scheme", 0)])
    assert url_filter.labelled_rows(df, "link", "block", limit=50) == labelled[:50]
    threshold, precision, recall = url_filter.best_threshold(labelled, precision=0.99)
    assert precision >= 0.99 and recall >= 0.9
    pages = spark.createDataFrame([(1, "http://new-casino.example/news/3"), (2, "http://new-museum.example/news/3")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, [], labelled, threshold=threshold).collect()} == {1: "block", 2: "allow"}
    chance = [(f"http://{n * 7919 % 1000}.example/", n % 2) for n in range(60)]
    assert url_filter.best_threshold(chance, precision=1.01)[0] > 1  # nothing is blocked where nothing was learned


def test_url_model_held_out_by_host():
    """Words that recur across hosts are learned; a word that only one host has is not."""
    hosts = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    labelled = [(f"http://{kind}-{h}.example/{k}", int(kind == "casino")) for kind in ("casino", "garden") for h in hosts for k in range(3)]
    found = url_filter.held_out(labelled, threshold=0.5)
    assert found == {"blocked": 24, "missed": 0, "blocked_wrongly": 0, "allowed": 24}
    # One host alone is all that a fold may learn from, and it is held out.
    alone = url_filter.held_out([("http://casino.example/1", 1), ("http://casino.example/2", 1), ("http://garden.example/", 0)])
    assert sum(alone.values()) == 3 and alone["blocked"] == 0


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    p = np.array([[0.3, 0.2, 0.1, 0.25, 0.15, 1e-7]])
    model = lang_id.Model(["xx"], pieces, p)
    want = 0.3 * 0.2 * 0.1 + 0.3 * 0.25 + 0.15 * 0.1
    assert np.isclose(np.exp(model.word("ab"))[0], want) and np.allclose(model.words(["ab", "zz", ""])[0], np.log(want))
    use, total = lang_id.expected("ab", pieces, p[0].tolist())
    assert np.isclose(total, want) and np.isclose(use[3], 0.3 * 0.25 / want)


def test_words_together_equal_words_alone():
    model = lang_id.fit({"en": {"the": 9, "thing": 4}, "de": {"der": 9, "größe": 3}}, lang_id.vocabulary(lang_id.vocabulary_path()))
    some = ["the", "größe", "x", "日本", "ab" * 30, "q" * 39, "a" * 41, "", "straße", "z" * 4000]
    assert np.allclose(model.words(some), np.array([model.word(w) for w in some]))


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = lang_id.query(spark, small).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert 0 < held.count() < docs.count()
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_messy(spark, messy, no_docs):
    model = lang_id.train(messy)
    out = {r.doc_id: r for r in lang_id.predict(messy, model, doc_id=messy["doc_id"], row=F.struct(*[messy[c] for c in messy.columns])).collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {3, 4, 5, 10, None} - ({None} if out[None].lang_pred != "und" else set())
    assert set(out[1].row.asDict()) == set(messy.columns)
    assert out[6].lang_pred == "en" and all(r.score == 0 for r in out.values() if r.lang_pred == "und")
    assert lang_id.predict(no_docs, model, doc_id=no_docs["doc_id"]).count() == 0
    empty = lang_id.train(no_docs)
    assert empty.langs == [] and {r.lang_pred for r in lang_id.predict(messy, empty, doc_id=messy["doc_id"]).collect()} == {"und"}
