"""Mixing, near duplicates, top-k, pages, languages, toxicity and the pipeline: against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest

from spatialfactor.llm import common, html_extract, language_id, mixing, near_dedup, packing, topk, toxicity

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing_meets_targets(documents, rows):
    got = mixing.mix_sources(documents).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    size_of = defaultdict(int)
    for _, t, s in rows:
        size_of[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size_of if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:  # the excess is shared again until no source is above three times its size
        share = (sum(size_of.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] > 3 * size_of[s]}
        if not above:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3.0 * size_of[s] for s in above}
        open_ -= above
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(documents).collect()))
    assert mixing.mix_sources(documents.limit(0)).count() == 0


def plain_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words)} if 0 < len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_of_documents(documents, rows):
    got = near_dedup.near_duplicates(documents, width=3, percent=85)
    want = plain_components([(i, t) for i, t, _ in rows if i is not None], 3, 85)
    assert got.count() == len(rows)
    for r in got.where("doc_id IS NOT NULL").collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    lost = got.where("doc_id IS NULL").first()
    assert lost.component_id == 1 and not lost.kept
    assert near_dedup.near_duplicates(documents.limit(0), width=3, percent=85).count() == 0


def test_near_duplicates_of_distinct_ids_in_sql(spark, documents):
    """The SQL of the query gives the same rows where ids are neither null nor repeated, with other words a shingle too."""
    distinct = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    with duckdb.connect() as db:
        db.register("documents", distinct.toPandas())
        for width, percent in ((3, 85), (5, 80), (1, 50)):
            want = db.sql(near_dedup.near_duplicates_sql(width, percent)).fetchall()
            got = near_dedup.near_duplicates(distinct, width, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
            assert sorted(map(tuple, got)) == sorted(want)


def test_near_duplicates_in_chains_and_crowds(spark):
    """Texts that drift step by step link only to their neighbours; a crowd around the threshold links in part."""
    rng, rows, key = random.Random(5), [], 0
    for _ in range(3):
        words = prose(rng, 120).split()
        for _ in range(12):
            rows.append((key, " ".join(words)))
            key += 1
            words[rng.randrange(120)] = f"w{key}"
            words[rng.randrange(120)] = f"v{key}"
    base = prose(rng, 90).split()
    for _ in range(40):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(90)] = f"u{key}x{rng.random()}"
        rows.append((key, " ".join(words)))
        key += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=3, percent=85).collect()}
    assert got == want


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64)) for _ in range(2))
    x, y, both = near_dedup.sketch([a, b, np.unique(np.concatenate((a, b)))])
    assert (np.maximum(x, y) == both).all()
    c = np.concatenate((a[:3600], b[:200]))
    r = near_dedup.sketch([a, np.unique(c)])
    agree = (r[0] == r[1]).mean()
    assert abs(agree - 3600 / 4200) < 0.1
    size = lambda *n: np.asarray(n, dtype=float)
    assert near_dedup.plausible(r[:1], r[1:], size(len(a)), size(len(c)), 0.85).all()
    assert not near_dedup.plausible(r[:1], near_dedup.sketch([b]), size(len(a)), size(len(b)), 0.85).any()


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}


def test_exact_top_k(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(0, 700)]
    rows += [(1000 + i, [0.5] * 6, "x") for i in range(300)] + [(2000, None, "x"), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (2002, [float("nan")] * 6, "x"), (2003, [float("inf")] * 6, "x"), (2004, [1.0], "x"), (2100, [1.0, 2.0], "x"), (None, [9.0] * 6, "x"), (7, rows[7][1], "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    monkeypatch.setattr(topk, "SHARD_ROWS", 128)
    monkeypatch.setattr(topk, "CELL_ROWS", 64)
    got = topk.exact_top_k(table).collect()
    sound = [(i, np.floor(1024 * np.asarray(x, dtype=np.float32).astype(float)).astype(int).tolist()) for i, x, _ in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = set()
    for q, x in dict((i, x) for i, x in sound if i % 100 == 0).items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q and len(y) == len(x))[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.exact_top_k(table.limit(0)).count() == 0
    ids, scores = topk.search_large(np.asarray([[2.0**60, 1.0]]), np.asarray([3]), np.asarray([2.0**60, 0.0]), 1, 10)
    assert ids == [3] and scores == [(1 << 63) - 1]


@pytest.mark.parametrize("table", [1 << 28, 12])
def test_alignment_is_a_longest_common_subsequence(table, monkeypatch):
    monkeypatch.setattr(html_extract, "TABLE", table)
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        kept = [x for x, s in zip(a, html_extract.lcs_shared(a, b), strict=True) if s]
        lengths = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lengths[i + 1][j + 1] = lengths[i][j] + 1 if x == y else max(lengths[i][j + 1], lengths[i + 1][j])
        rest = iter(b)
        assert len(kept) == lengths[-1][-1] and all(x in rest for x in kept)


def test_pages(spark, monkeypatch):
    frame = '<div>Home</div><div class="ad">Buy</div>{}<div>All about us</div><footer>f</footer><script>x<p></script>'
    rows = [(i, f"http://h.example.com/a/{i}", frame.format(f"<p>Text {i} &amp; more<br>of&nbsp;it<p>Second {i}"), "t") for i in range(9)]
    article = "<nav>n</nav><article><header><h1>T</h1></header><p>Same</p><section class='comments'><p>c</p></section></article>"
    rows += [(20, "http://k.example.com/x", article, "t"), (21, "https://k.example.com/x?a=1", article, "t"), (22, "http://lone.example.com/", "<p>only</p>", "t"), (23, None, None, "t"), (None, "http://h.example.com/a/3", "", "t"), (22, "http://lone.example.com/", "<p>only</p>", "t")]
    monkeypatch.setattr(html_extract, "RANGE_ROWS", 3)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for i in range(9):
        assert got[i].text == f"Text {i} & more of it\n\nSecond {i}" and got[i].n_chars == len(got[i].text)
    assert got[20].text == got[21].text == "T\n\nSame" and got[22].text == "only" and got[23].text == "" and got[None].text == ""
    assert html_extract.extract_main_text(pages).count() == len(rows) and html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_tags_with_long_values_and_unpaired_quotes():
    uri = "data:image/png;base64," + "QUJD" * 25_000
    page = f'<p>out<img src="{uri}">side</p><div class="nav" data-x=\'{uri}\'>menu</div><article><p>in<img alt=x src="{uri}">side</p></article>'
    assert html_extract.blocks(page) == [("outside", False, False), ("menu", False, True), ("inside", True, False)]
    page = "<div title=\"x>a</div><p title=John's>b</p><p class='nav>c</p><a href=/q?a=1>d</a>"
    assert html_extract.blocks(page) == [("a", False, False), ("b", False, False), ("c", False, True), ("d", False, False)]
    assert html_extract.blocks('<p title="a>b">t</p><a href=/q?a="x>y</a>') == [("t", False, False), ("y", False, False)]
    assert html_extract.blocks("<a b=\"c' " * 50_000) == []


def test_differencing_inside_the_main_part(spark):
    page = "<nav>n</nav><main><div>Home</div><div>News</div><h1>Title {0}</h1><p>The whole story number {0}, told at length</p><div>Tell your friends</div></main>"
    rows = [(i, f"http://m.example.com/{i}", page.format(i)) for i in range(4)]
    rows += [(10, "http://c.example.com/a", page.format("x")), (11, "http://c.example.com/b", page.format("x") + "<footer>other</footer>"), (12, "http://c.example.com/c", page.format("y"))]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nThe whole story number {i}, told at length" for i in range(4))
    # a copy of the article deletes nothing of it, but the page beyond it does
    assert "The whole story number x, told at length" in got[10] and got[11] == "Title x\n\nThe whole story number x, told at length"


def test_runs_of_copies_meet_the_pages_beyond(spark, monkeypatch):
    frame = "<div>Home</div><p>Text {}</p><div>All about us</div>"
    rows = [(i, f"http://h.example.com/a?x={i}", frame.format("one")) for i in range(40)]
    rows += [(50 + i, f"http://h.example.com/b{i}", frame.format("two")) for i in range(20)] + [(80, "http://h.example.com/b5", ""), (90, None, "<p>alone")]
    rows += [(100 + i, f"http://g.example.com/{i}", frame.format("copy")) for i in range(9)]
    for n in (2, 5, 500):
        monkeypatch.setattr(html_extract, "RANGE_ROWS", n)
        got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        assert len(got) == len(rows) and got[80] == "" and got[90] == "alone"
        assert all(got[i] == "Text one" for i in range(40)) and all(got[50 + i] == "Text two" for i in range(20))
        assert all(got[100 + i] == "Home\n\nText copy\n\nAll about us" for i in range(9))


def test_pages_beyond_a_range_are_the_nearest_that_differ():
    rng = random.Random(5)
    for _ in range(300):
        pages = sorted((rng.choice("gh"), i) for i in range(rng.randint(1, 14)))
        pages = [(host, rng.choice("xy"), i) for host, i in pages]
        cuts = sorted(rng.randint(0, len(pages)) for _ in range(4))
        ranges = [pages[i:j] for i, j in zip([0, *cuts], [*cuts, len(pages)], strict=True)]
        held = html_extract.beyond([html_extract.last_two(r) for r in ranges])
        for at, (own, before) in enumerate(zip(ranges, held, strict=True)):
            for n, page in enumerate(own):
                nearest = lambda among: next((p for p in reversed(among) if p[0] == page[0] and p[1] != page[1]), None)  # noqa: B023, E731
                assert nearest(sorted(before, key=pages.index) + own[:n]) == nearest([p for r in ranges[:at] for p in r] + own[:n])


def test_languages_fuse_evidence(spark):
    rng = random.Random(4)
    words = {"xx": ("zor", "vek", "plin"), "yy": ("aou", "eia", "oio")}
    text = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(lang, text(lang, 40)) for lang in words for _ in range(20)], "lang string, text string")
    pages = [(i, f"http://{lang}.host.example/{i}", f'<html lang="{lang}"><body><p>{text(lang, 30)}</p>', "z") for i, lang in enumerate(["xx", "yy"] * 15)]
    pages += [(100, "http://xx.host.example/none", "<html><body></body>", "z"), (101, None, None, "z"), (102, "http://yy.host.example/q", '<html lang="yy"><p>!</p>', "z")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, lang string")
    got = {r.page_id: r for r in language_id.language_id(table, docs).collect()}
    assert all(got[i].lang == lang for i, lang in enumerate(["xx", "yy"] * 15))
    assert got[100].lang == "xx" and got[102].lang == "yy" and len(got) == len(pages)
    assert all(r.lang is None for r in language_id.language_id(table, docs.limit(0)).collect())
    assert language_id.language_id(table.limit(0), docs).count() == 0


def plain_fusion(pages, model, enough):
    """(lang, posterior, language by text) of each page (host, html): sums of the other pages, level by level."""
    size, smooth = len(model.languages), language_id.SMOOTH
    found = []
    for host, html in pages:
        lines = html_extract.blocks(html or "")
        main = [x for x, is_main, frame in lines if is_main and not frame] or [x for x, _, frame in lines if not frame]
        grams = language_id.trigrams(" ".join(main))
        z = np.zeros(size)
        for g in grams:
            z += model.table[:, g] * language_id.TEMPER * min(1.0, enough / len(grams))
        z -= z.max()
        said = re.search(r'<html lang="(\w+)"', html or "")
        parts = host.split(".")
        found.append((z, np.exp(z) / np.exp(z).sum(), {"h": host, "d": ".".join(parts[-3:]), "s": parts[-1], "m": said[1] if said else ""}))
    everything = sum(share for _, share, _ in found)
    base = (everything + 1) / (everything.sum() + size)
    out = []
    for at, (z, share, keys) in enumerate(found):
        others = {k: sum((other for n, (_, other, theirs) in enumerate(found) if n != at and theirs[k] == keys[k]), np.zeros(size)) for k in keys}
        prior = base
        for level in "sdh":
            prior = (others[level] + smooth * prior) / (others[level].sum() + smooth)
        total = z + np.log(prior)
        if keys["m"]:
            total = total + np.log((others["m"] + smooth * base) / (others["m"].sum() + smooth)) - np.log(base)
        posterior = np.exp(total - total.max())
        out.append((model.languages[int(np.argmax(total))], 1.0 / posterior.sum(), model.languages[int(np.argmax(share))]))
    return out


@pytest.mark.parametrize("enough", [300, 20, 10**9])
def test_languages_against_a_plain_fusion(spark, enough):
    """Null and repeated ids, repeated rows, no host, no text, no declaration, a wrong one, ties, a very long page."""
    rng = random.Random(21)
    words = {"xx": ("zor", "vek", "plin"), "yy": ("aou", "eia", "oio"), "zz": ("zor", "eia", "tam")}
    text = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(3)) for _ in range(n))
    docs = [(lang, text(lang, 40)) for lang in words for _ in range(8)]
    page = lambda lang, said, n: f'<html lang="{said}"><body><p>{text(lang, n)}</p>' if said else f"<html><body><p>{text(lang, n)}</p>"
    hosts = ["a.one.example", "b.one.example", "c.two.example", "a.one.test", "lone.test", ""]
    table = [(i, rng.choice(hosts), page(rng.choice("xx yy zz".split()), rng.choice(("xx", "yy", "zz", "")), rng.choice((0, 1, 2, 30)))) for i in range(60)]
    table += [(None, "a.one.example", page("xx", "yy", 3)), (7, "c.two.example", page("yy", "", 1)), table[3], table[3], (61, "lone.test", page("zz", "zz", 30_000)), (62, "", None), (63, "", "")]
    rows = [(i, f"http://{host.upper()}/p" if host else None, html, "x", 0.5, "y") for i, host, html in table]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, t0 double, suffix string")
    got = language_id.language_id(frame, spark.createDataFrame(docs, "lang string, text string"), enough=enough).collect()
    want = plain_fusion([(host, html) for _, host, html in table], language_id.fit_text_model(docs), enough)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[4])
    found = sorted(((r.page_id, r.url, r.lang, r.text_lang, round(r.confidence, 7)) for r in got), key=order)
    expected = sorted(((i, url, lang, by_text, round(sure, 7)) for (i, url, *_), (lang, sure, by_text) in zip(rows, want, strict=True)), key=order)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a[:2] == b[:2] and abs(a[4] - b[4]) < 1e-6
        # languages of equal posterior may change places by rounding
        assert a[2:4] == b[2:4] or a[4] < 0.5
    assert any(r.lang != r.text_lang for r in got)


def test_toxicity_on_held_out_rows(spark, documents):
    rng, rows, labels = random.Random(9), [], []
    for i in range(700):
        words, toxic = prose(rng, 60).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(("grubwick", "mofflet", "quazzer")) + rng.choice(("", "en", "ish"))
        rows.append((i, " ".join(words), "toxic" if not toxic else "fine"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, marks).where("held_out").collect()
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in got]
    assert len(got) > 150 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 560
    assert toxicity.score_toxicity(documents, marks.limit(0)).count() == documents.count()


def test_toxicity_of_odd_rows_with_a_model():
    rng, rows = random.Random(9), []
    for i in range(400):
        words = prose(rng, 50).split()
        for _ in range(3 * (i % 4 == 0)):
            words[rng.randrange(50)] = rng.choice(("grubwick", "mofflet", "quazzer"))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    model = toxicity.fit(rows)
    clean, bad = prose(rng, 40_000), "you MOFFLET! " + prose(rng, 30) + " (Grubwick)"
    scores = model.scores(["", "  \n", "12 34", clean[:300], bad, bad, "x" * 5_000_000, bad + " \U0001f600 \ud800", clean + " " + bad * 20])
    assert max(scores[:4]) < 0.7 <= min(scores[4:6]) and scores[4] == scores[5] and scores[6] < 0.7 <= scores[7] and all(0 <= s <= 1 for s in scores)
    assert model.scores([]) == [] and toxicity.fit(rows[1:4]) is None
    # the two dictionaries are told apart by windows alone
    assert toxicity.gains(model.ordinary, model.toxic, ["mofflet"])[0] >= toxicity.CHOSEN > max(toxicity.gains(model.ordinary, model.toxic, ["ba", "retion"]))


def test_toxicity_lengths_are_those_of_single_compression():
    words = ["alpha", "beta", "gamma delta", "x"]
    data = b"".join(map(toxicity.wide, words)) * 3
    assert toxicity.lengths(data, [toxicity.wide(w) for w in words]).tolist() == [len(toxicity.compressor(data).compress(toxicity.wide(w))) for w in words]


def test_wrappers_and_teasers_do_not_empty_a_page():
    text = "Text one that is long enough to count as the page"
    content = lambda page: html_extract.content(html_extract.blocks(page))
    assert content(f'<form id="aspnetForm"><div class="nav">menu</div><p>{text}</p></form>') == [text]
    page = '<div class="page-with-sidebar"><div class=sidebar>links</div><article><p>Main</p><section id="search-methods"><p>How</p></section><section class="related-work"><p>Others</p></section><div class="site-footer">f</div></article></div>'
    assert content(page) == ["Main", "How", "Others"]
    assert content(f"<div><article class=teaser><p>Short</p></article><p>{text}</p></div>") == ["Short", text]
    assert content(f'<div class="comments"><article><p>a remark</p></article></div><p>{text}</p>') == [text]
    assert content('<div class="ad-banner box">x</div><nav>only</nav>') == []
    assert content("<p>" + "word " * 1_000_000) == [("word " * 1_000_000).strip()]


def test_cells_hold_every_vector():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    dims, at = topk.cut_cells(x[:300], 3)
    cells = topk.cell_of(x, dims, at)
    assert set(cells.tolist()) == set(range(8)) and np.bincount(cells).max() < 600
    same = topk.cell_of(np.zeros((10, 5)), *topk.cut_cells(np.zeros((4, 5)), 2))
    assert len(set(same.tolist())) == 1


def test_pipeline_stages(spark, documents, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    table = documents.select("doc_id", "text", "lang", "source", "n_chars")
    bad = [(1000 + i, f"mofflet {prose(rng, 30)} grubwick {prose(rng, 9)} quazzer", "en", "s1", 9) for i in range(60)]
    fine = [(2000 + i, prose(rng, 40), "en", "s2", 9) for i in range(200)]
    table = table.union(spark.createDataFrame(bad + fine, table.schema))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(r[0], int(r[0] < 2000)) for r in bad + fine]
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        if name == "toxicity":
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            assert len([i for i in kept if i is not None and 1000 <= i < 2000]) <= 3 and {i for i, _, _, _, _ in fine} <= kept and {103, 104, None} <= kept
        if name == "personal_data":
            before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in out.collect())
            assert before == after and "[EMAIL]" in out.where("doc_id = 107").first().text
        if name == "mixing":
            plain = mixing.mix_sources(docs).where("size > 0").selectExpr("doc_id", "cast(taken / size as int) AS n").collect()
            want = Counter()
            for r in plain:
                want[r.doc_id] += r.n
            assert Counter(r.doc_id for r in out.collect()) == +want
        if name == "near_dedup":
            assert None in {r.doc_id for r in out.collect()}
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert 100 not in ids and 101 not in ids and 102 not in ids and {0, 103, 104} <= set(ids)
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == Counter(map(tuple, docs.drop("sequence_id", "offset").collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_rows_without_ids_are_those_of_an_anti_join(spark):
    """Null and repeated keys, ids that share a bit with others, and rows whose own id column is another one."""
    keys = [None, None, 7, 7, *range(2000)]
    rows = spark.createDataFrame([(k, f"i{k}", f"t{k}") for k in keys], "doc_id bigint, id string, text string")
    gone = spark.createDataFrame([(k,) for k in (7, 11, 5000, *range(100, 200))], "doc_id bigint")
    for bits in (near_dedup.BITS, 1 << 15):
        before, near_dedup.BITS = near_dedup.BITS, bits
        try:
            got = near_dedup.without(rows, gone, "doc_id")
            assert got.columns == rows.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(gone, "doc_id", "left_anti").select(rows.columns).collect()))
        finally:
            near_dedup.BITS = before
    assert near_dedup.without(rows, gone.limit(0), "doc_id").count() == len(keys)


def test_a_worker_drops_what_another_operator_kept(spark, documents):
    """Workers live on from stage to stage: their tables and freed memory are not carried into the next operator."""
    path = public_tokenizers.path("word_bpe_49k.json")

    def held(batches):
        for batch in batches:
            yield {"n": [packing.encoder.cache_info().currsize] * len(batch["id"])}

    numbers = spark.range(64).repartition(16)
    packing.cut_pieces(documents.repartition(8), path).write.format("noop").mode("overwrite").save()
    assert {r["n"] for r in common.map_rows(numbers, held, "n bigint").collect()} == {0}


def test_thinned_rows_hold_all_that_a_join_needs(spark):
    from spatialfactor.llm import near_dedup

    rows = spark.range(20_000).selectExpr("id * 7919 - 50000 AS id", "string(id) AS data")
    wanted = rows.where("id % 97 = 0").select("id")
    kept = near_dedup.thinned(rows, wanted)
    assert kept.columns == ["id", "data"] and wanted.exceptAll(kept.select("id")).isEmpty()
    assert wanted.count() <= kept.count() < wanted.count() + 200
    assert near_dedup.thinned(rows, wanted.limit(0)).isEmpty()
