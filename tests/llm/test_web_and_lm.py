import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from evtrail.llm import lm_score, url_reputation, wrapper
from tests.llm.helpers import docs, frame, odd_texts, words_of

PAGES = "page_id long, url string, html string, host string, text string, constants string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", 0) for i, u, h in rows], PAGES)


# ------------------------------------------------------------ pages ------

ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class=site><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><!-- c --><div id="cookie-notice">We use
cookies</div><main><article class="post"><header><h1>Title &amp; more</h1><span>By x</span></header><p>One   two<br>three</p>
<ul><li>item 1<li>item 2</ul><div class="share-buttons">Share</div><p>Four <a href=y>five</a>&nbsp;<b>six</p><aside>s</aside>
<form>f</form><div class=ad-box><p>Buy</p></div><footer>ff</footer></article><section id=comments><article class=comment>
<p>nice nice nice nice</p></article></section></main><footer>&copy;</footer></body></html>"""


def test_main_text_of_an_article():
    assert wrapper.main_text(ARTICLE).split("\n") == ["Title & more", "One two three", "item 1", "item 2", "Four five six"]


@pytest.mark.parametrize("page,text", [
    ("", ""), ("no tags & x < y", "no tags & x < y"), ("<p>a<table><tr><td>1<td>2<tr><td>3</table>b", "a\n1\n2\n3\nb"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut</p><p", "cut"), ("<article><p>a</p><script>x", "a"), ("<p>x</p>" * 3, "x\nx\nx"),
    ("<article><p>1 &lt; 2 &#8364;</p></article>", "1 < 2 €"), ('<p title="a>b">q</p>', "q"),
    ("<div>text<ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>", "text"),
])
def test_main_text_of_odd_pages(page, text):
    assert wrapper.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<article><p>long " + "word " * 50 + "</p></article><article><p>Update: short.</p></article>",
     ("long " + "word " * 50).strip() + "\nUpdate: short."),
    ("<main><p>Before.</p><article><p>Inside.</p></article><p>After.</p></main>", "Before.\nInside.\nAfter."),
    ("<main><p>One.</p></main><p>out</p><main><p>Two is longer.</p></main>", "One.\nTwo is longer."),
    ("<div class=entry><p>One.</p></div><div>x</div><div class=entry><p>Two is <b>longer</b>.</p></div>",
     "One.\nTwo is longer."),
    ("<p>Body.</p><p>See <a href=1>a long reference</a>, <a href=2>another reference</a>.</p>"
     "<ul><li>1. <a href=3>third reference</a></ul>",
     "Body.\nSee a long reference, another reference.\n1. third reference"),
    ("<p>text</p>\n<ul>\n <li><a href=1>one</a> | </li>\n <li><a href=2>two</a>&nbsp;</li>\n</ul>", "text"),
    ("<article></article><div id=content><p>text</p></div>", "text"),
    ("<main><div><article><p>Text.</p></article></div><p>After.</p></main><section><article>Teaser</article></section>",
     "Text.\nAfter."),
    ("<main><p>Intro.</p></main><article><p>Text.</p></article>", "Intro.\nText."),
    ("<main><article></article></main><article><p>Text.</p></article>", "Text."),
])
def test_no_content_is_left_out_for_length_or_links(page, text):
    assert wrapper.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ('<div class="content with-sidebar"><article><p>Body of it.</p></article><div class=sidebar>side</div></div>',
     "Body of it."),
    ("<div class=no-sidebar><p>Body of it.</p></div>", "Body of it."),
    ("<div class=has-banner><div class=banner>b</div><p>Body of it.</p></div>", "Body of it."),
    ('<article class="post social"><p>Body of it.</p></article>', "Body of it."),
    ("<div class=layout-sidebar-left><p>Body of the page.</p></div><div class=sidebar-box>side</div>",
     "Body of the page."),
    ("<div class=overlay><main><p>Body of it.</p></main></div>", "Body of it."),
    ("<article><p>Body.</p></article><section id=comments><article><p>nice " + "nice " * 40 + "</p></article></section>",
     "Body."),
    ("<div class=overlay><main>Body.</main></div><div>" + "other " * 40 + "</div>", "Body."),
    ("<article><p>Body.</p></article><div class=comments-area><p>nice " + "nice " * 40 + "</p></div>", "Body."),
    ("<p>Body.</p><div class=comments><p>nice " + "nice " * 40 + "</p></div>", "Body."),
    ("<div class=cookie-notice>We use cookies</div><p>Body of the page.</p>", "Body of the page."),
    ("<article><p data-class='ad'>One.</p><p data-id='menu-1'>Two.</p><p title='class=ad x'>Three.</p></article>",
     "One.\nTwo.\nThree."),
    ("<article><p data-hidden=1 x-style='display:none'>One.</p><p CLASS = ad>no</p><p hidden>no</p></article>", "One."),
    ("<p aria-hidden=false>One.</p><p aria-hidden='true'>no</p><p class=a id=ad-1>no</p>", "One."),
    ("<main><div class='search results'><p>one result text</p></div></main><div class=ad>x</div>", "one result text"),
    ("<main><p>Text.</p><div class='search results'><p>other</p></div></main>", "Text."),
])
def test_layout_words_do_not_drop_the_content(page, text):
    assert wrapper.main_text(page) == text


def test_tree_matching_is_the_largest_simple_matching():
    rng = random.Random(3)

    def tree(depth):
        return rng.choice("ab"), (), tuple(tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0))

    def plain(a, b):
        if a[0] != b[0]:
            return 0

        def seq(x, y):
            if not x or not y:
                return 0
            w = plain(x[0], y[0])
            return max(seq(x[1:], y), seq(x, y[1:]), w + seq(x[1:], y[1:]) if w else 0)
        return 1 + seq(a[2], b[2])
    for _ in range(200):
        a, b = tree(3), tree(3)
        n = wrapper.tree_match(a, b, {})
        assert n == plain(a, b)
        assert sum(1 for _ in wrapper.aligned(a, b)) == n


def site_page(i, varying, constant="Subscribe to our letter today."):
    return (f"<html><body><div class=brand>Brand</div><article><h1>Head {i}</h1><p>{varying}</p>"
            f"<p>{constant}</p></article><div>Made by us</div></body></html>")


def test_constant_slots_become_template(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "CHUNK", 4)           # several chunks a host
    rows = [(i, "http://a.com/x", site_page(i, f"body number {i} here")) for i in range(12)]
    rows += [(100 + i, "http://b.com/", site_page(i, f"other {i}", f"no template {i}")) for i in range(12)]
    rows += [(200 + i, "http://c.com/", site_page(0, "the same page")) for i in range(12)]      # copies only
    rows += [(300, None, None), (None, "nohost", ""), (301, "http://a.com/", rows[0][2])]
    got = wrapper.extract_main_text(pages(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Head 3\nbody number 3 here"
    assert text[103] == "Head 3\nother 3\nno template 3"
    assert text[205] == "Head 0\nthe same page\nSubscribe to our letter today."
    assert text[300] == "" == text[None] and text[301] == text[0]
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrapper.extract_main_text(pages(spark, [])).count() == 0


def test_template_of_few_pages_and_of_several_layouts(spark):
    def other(i):
        return (f"<html><body><div class=brand>Brand</div><section class=story><h1>Head {i}</h1><p>text {i} of it</p>"
                f"<p>Made for the second layout.</p></section></body></html>")
    rows = [(i, "http://two.com/", site_page(i, f"body {i} here")) for i in range(2)]
    rows += [(100 + i, "http://half.com/", site_page(i, f"body {i} here") if i % 2 else other(i)) for i in range(20)]
    # a notice that a third of the pages have, the first tree or not
    rows += [(200 + i, "http://some.com/", f"<article><h1>Head {i}</h1><p>text {i} of it</p>"
              + ("<div class=letter>Get our letter today.</div>" if i % 3 == 0 else "") + "</article>")
             for i in range(12)]
    rows += [(300, "http://one.com/", site_page(0, "alone"))]
    text = {r.page_id: r.text for r in wrapper.extract_main_text(pages(spark, rows).repartition(3)).collect()}
    assert text[1] == "Head 1\nbody 1 here"
    assert text[101] == "Head 1\nbody 1 here" and text[102] == "Head 2\ntext 2 of it"
    assert all(text[200 + i] == f"Head {i}\ntext {i} of it" for i in range(12))
    assert text[300] == "Head 0\nalone\nSubscribe to our letter today."


def test_folding_keeps_places_and_counts():
    def tree(html, n=1):
        return wrapper.skeleton(wrapper.compact(wrapper.parse(html)), n)

    def plain(node):
        return node[3], [plain(kid) for kid in node[2]]
    whole = tree("<div><p>a</p></div><ul><li>b</li></ul><h2>c</h2>", 3)
    wrapper.fold(whole, tree("<div><p>x</p><h3>new</h3></div><table><tr><td>n</td></tr></table><h2>c</h2>", 2))
    # the table comes before the next node that both have; the list stays where it was
    assert plain(whole) == (5, [(5, [(5, []), (2, [])]), (2, [(2, [(2, [])])]), (3, [(3, [])]), (5, [])])
    wrapper.name_nodes(whole)
    todo, names = [whole], []
    while todo:
        node = todo.pop()
        names.append(node[4])
        todo += node[2]
    assert len(set(names)) == len(names) == 10
    assert plain(wrapper.pruned(whole, 3)) == (5, [(5, [(5, [])]), (3, [(3, [])]), (5, [])])


def test_long_sibling_lists_are_paired_in_order():
    a = ("r", (), tuple((f"s{i % 7}", (), ()) for i in range(400)))
    b = ("r", (), tuple(x for i, x in enumerate(a[2]) if i % 5 != 3))
    assert len(a[2]) * len(b[2]) > wrapper.CELLS
    pairs = list(wrapper.aligned(a, b))
    assert len(pairs) == len(b[2]) + 1 and all(p[0] == q[0] for p, q in pairs)


def test_long_sibling_lists_are_matched_as_short_ones(monkeypatch):
    rng = random.Random(5)

    def leaves(n, kinds):
        return tuple((rng.choice(kinds), (), tuple((rng.choice("xy"), (), ()) for _ in range(rng.randint(0, 2))))
                     for _ in range(n))

    for n in range(60):
        a, b = (("r", (), leaves(rng.randint(1, 14), "ab" if n % 2 else "abcdef")) for _ in range(2))
        monkeypatch.setattr(wrapper, "CELLS", 1 << 14)
        whole = [(id(p), id(q)) for p, q in wrapper.aligned(a, b)]
        monkeypatch.setattr(wrapper, "CELLS", 0)                # all by rows
        assert [(id(p), id(q)) for p, q in wrapper.aligned(a, b)] == whole
    # the row that both have is 200 places on in one of them: no list is too long to find it
    monkeypatch.setattr(wrapper, "CELLS", 1 << 14)
    one, rest = [tuple((f"{s}{i}", (), ()) for i in range(150)) for s in "ab"]
    a, b = ("r", (), (*one, ("same", (), ()), *one)), ("r", (), (*rest, ("same", (), ()), *rest[:20]))
    memo = {}
    assert wrapper.tree_match(a, b, memo) == 2
    assert [p[0] for p, q in wrapper.aligned(a, b, memo)] == ["r", "same"]
    assert len(memo) < 1000                                     # not one entry a cell


def test_extraction_of_planted_sites_is_their_content(spark, monkeypatch):
    """Sites of random blocks: each slot is either constant or varies, blocks
    are equal in tag and class, and some are on a part of the pages only.  The
    text has to be the varying ones and headings, by the plan of the site."""
    monkeypatch.setattr(wrapper, "CHUNK", 5)
    monkeypatch.setattr(wrapper, "FAN", 2)
    rng = random.Random(11)
    rows, want = [], {}
    for site in range(6):
        plan = [(rng.random() < 0.5, rng.choice(["always", "always", "half"]), rng.randint(1, 3)) for _ in range(9)]
        for n in range(40):
            body, text = [f"<h1>Head {site} {n}</h1>"], [f"Head {site} {n}"]
            for slot, (constant, when, depth) in enumerate(plan):
                if when == "half" and (n + slot) % 2:
                    continue
                t = f"slot {slot} of site {site}" + ("" if constant else f" on page {n}")
                # the boxes are equal; what they hold tells them apart
                body.append("<div class=box>" + f"<section class=slot{chr(97 + slot)}>" * depth + f"<p>{t}</p>" + "</section>" * depth
                            + "</div>")
                if not constant:
                    text.append(t)
            key = site * 100 + n
            rows.append((key, f"http://site{site}.org/{n}", "<article>" + "".join(body) + "</article>"))
            want[key] = "\n".join(text)
    got = {r.page_id: r.text for r in wrapper.extract_main_text(pages(spark, rows).repartition(4)).collect()}
    assert got == want


def test_equal_siblings_are_told_apart_by_alignment(spark):
    """Two equal elements, the second always the same: its place in the tree,
    not its path, makes it template."""
    def page(i):
        return (f"<article><h1>Head {i}</h1><div class=b><p>text {i}</p><ul><li>a {i}</li></ul></div>"
                f"<div class=b><p>our fixed line</p></div></article>")
    rows = [(i, "http://same.org/", page(i)) for i in range(6)]
    # the fixed line as a page's own text elsewhere in the tree is content
    rows.append((50, "http://same.org/", "<article><h1>Head</h1><div class=b><p>our fixed line</p><ul><li>x</li></ul></div>"
                                         "<div class=b><p>our fixed line</p></div></article>"))
    text = {r.page_id: r.text for r in wrapper.extract_main_text(pages(spark, rows)).collect()}
    assert text[3] == "Head 3\ntext 3\na 3"
    assert text[50] == "Head\nour fixed line\nx"


# ------------------------------------------------------------- urls ------

def test_url_verdicts(spark):
    rows = [(0, "http://Example.COM/en/a?q#f", ""), (1, "https://www.example.com/en/", ""), (2, "ftp://x.net/es/1", ""),
            (3, "http://x.net/de/1", ""), (4, None, ""), (5, "no scheme", ""), (6, "http://a.co.uk", ""),
            (7, "http://h.org?x=/y", ""), (8, "://com/", ""), (None, "http://u@evil.org:80/p", ""), (9, "http://notexample.com/en/", "")]
    rows += [(100 + i, f"http://bad.evil.org/{i}", "") for i in range(60)]
    rows += [(200 + i, f"http://good.fine.org/{i}", "") for i in range(60)]
    labels = spark.createDataFrame(
        [(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(3, None, None), (None, 0, 1),
                                                                                      (200, 1, 0)],
        "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages(spark, rows), labels).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("example.com", "/en/a", "example.com/en/", "block")
    assert (got[1].rule, got[1].verdict) == ("www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/es/", "block") and got[3].rule is None
    assert (got[4].host, got[4].path, got[5].host) == ("", "", "") and got[7].path == "" and got[7].host == "h.org"
    assert got[8].rule == "com/" and got[9].rule == "com/"
    assert got[None].host == "u@evil.org:80"
    assert got[100].verdict == "block" and got[200].verdict == "allow" and got[6].verdict == "allow"
    none = url_reputation.judge_urls(pages(spark, rows), labels.limit(0)).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"}
    assert url_reputation.judge_urls(pages(spark, []), labels).count() == 0


def test_reputation_shrinks_towards_its_parents(spark):
    o = spark.createDataFrame(
        [("a.bad.com", 40.0, 38.0), ("b.bad.com", 40.0, 39.0), ("new.bad.com", 0.0, 0.0), ("x.ok.com", 40.0, 2.0),
         ("y.ok.com", 40.0, 1.0), ("new.ok.com", 0.0, 0.0)], "host string, n double, bad double")
    r = {x.host: x for x in url_reputation.host_reputation(o).collect()}
    assert r["new.bad.com"].mean > 0.7 > 0.3 > r["new.ok.com"].mean
    assert r["a.bad.com"].lower < r["a.bad.com"].mean < 1


# --------------------------------------------------------------- lm ------

def test_lm_base_counts_and_held_out_score(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    rows = list(odd_texts())
    for i in range(1000, 1300):
        words, w = [], rng.randrange(60)
        for _ in range(60):
            w = (w + rng.choice((1, 1, 1, 2, 7))) % 60                 # the next word depends on the last
            words.append(vocab[w])
        rows.append((i, " ".join(words)))
    got = lm_score.lm_scores(frame(spark, rows).repartition(3)).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    c = Counter()
    for i, t in rows:
        if fold(i):
            c.update([*words_of(t), ""])
    n, v = sum(c.values()), len(c)

    def plain(i, t):
        w = [*words_of(t), ""]
        return (i, fold(i) == 0, len(w), sum(c[x] > 0 for x in w), n,
                round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
                   for r in got) == Counter(plain(i, t) for i, t in rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)      # both are negative


def test_lm_learns_from_every_position(spark, monkeypatch):
    texts = ["same first words " * 6 + f"then number {i} and {i * i}" for i in range(30)] + ["one", "", "two words"] * 3
    sums = []
    own = lm_score._corpus_sums

    def kept(events, shared, observed, *a, **b):
        sums.append((observed, own(events, shared, observed, *a, **b)))
        return sums[-1][1]
    monkeypatch.setattr(lm_score, "_corpus_sums", kept)
    df = frame(spark, list(enumerate(texts))).repartition(3)
    vocab, weights, _ = lm_score.train(spark, df.select(lm_score.text_bytes().alias("t")), rounds=1)
    make = lm_score.Featurizer(vocab)
    want = np.zeros(weights.cls.shape)
    words = np.zeros(weights.word.shape)
    for t in texts:
        codes = make.codes(lm_score.tokens_of(t.encode()))
        for f, c in zip(make.features(codes), codes):
            want[f, c // lm_score.CLASS_SIZE] += 1
            words[f, c // lm_score.CLASS_SIZE, c % lm_score.CLASS_SIZE] += 1
    (seen, (cls, word)), (guess, (e_cls, _)) = sums
    assert seen and not guess
    assert (cls == want).all() and (word == words).all()
    assert abs(e_cls.sum() - lm_score.TEMPLATES * vocab.total) < 1


def test_lm_is_a_distribution(spark):
    texts = [" ".join(f"t{(i * k) % 1500}" for k in range(200)) for i in range(1, 60)]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)])
    vocab, weights, _ = lm_score.train(spark, df.select(lm_score.text_bytes().alias("t")), rounds=2)
    make = lm_score.Featurizer(vocab)
    feats = make.features(make.codes(lm_score.tokens_of(texts[3].encode())))[5:6]
    codes = np.arange(len(vocab.tokens))
    p = 10 ** lm_score.log10_probabilities(vocab, weights, codes, np.repeat(feats, len(codes), axis=0))
    rare = 10 ** (lm_score.log10_probabilities(vocab, weights, np.array([-1]), feats) + vocab.tail_log10(0))
    assert abs(p.sum() + rare.sum() - 1) < 1e-3


def test_lm_gradient_is_observed_less_expected():
    vocab = lm_score.Vocabulary([b"a", b"b", b"", b"c"], np.array([5, 4, 3, 2]), 16, 6, 2, 2, 0.5)
    w = lm_score.start_weights(vocab)
    rng = np.random.default_rng(0)
    w.cls += rng.normal(0, 0.1, w.cls.shape).astype(np.float32)
    w.word += rng.normal(0, 0.1, w.word.shape).astype(np.float32)
    make = lm_score.Featurizer(vocab)
    codes = make.codes([b"a", b"zz", b"b", b"a", b"c", b""])
    feats = make.features(codes)
    head = codes >= 0
    rows = np.column_stack([feats, np.where(head, 0, 1), np.where(head, codes, -1)]).astype(np.int16)
    (oc, ow), (ec, ew) = lm_score.gradient(w, rows, True), lm_score.gradient(w, rows, False)

    def total():
        return lm_score.log10_probabilities(vocab, w, codes, feats).sum() * math.log(10)
    for table, o, e, at in ((w.cls, oc, ec, (feats[1, 0], 1)), (w.word, ow, ew, (feats[2, 0], 0, 1))):
        old = table[at]
        table[at] = old + 0.01
        up = total()
        table[at] = old - 0.01
        down = total()
        table[at] = old
        assert abs((up - down) / 0.02 - (o - e)[at]) < 1e-2


def test_lm_without_anything_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_score.lm_scores(frame(spark, [(held, "some words"), (held, None)])).collect()
    assert sorted((x.n_tokens, x.n_known, x.train_tokens, x.score) for x in r) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm_score.lm_scores(frame(spark, [])).count() == 0


def test_docs_fixture_is_whole(spark):
    assert docs(spark).count() == len(odd_texts())
