"""Alignment, URL filters and importance resampling against plain versions, on rows of every kind."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from spatialfactor.llm import alignment, importance, queries, url_filter

from .conftest import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", "  two  spaces ", "tab\tand\nlines\r\n", "<|endoftext|> plain", "été ▁ underline", "\u0000\u0007", "日本語テキスト😀👩‍👩‍👧", "don't won't", "ﬁ ligature", "ab" * 300, " " * 50, "İı ſ \u2028 x", "e\u0301 combining"]


def plain_alignment(texts):
    """Groups by common ends, links by equal ends, counts over all texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    p = SentencePieceProcessor(model_file=B)
    shown = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True)}
    hidden = [b for b in range(256) if b not in shown]
    shown |= {256 + i: b for i, b in enumerate(hidden)}
    rows, counts = [], Counter()
    for text in texts:
        ids_a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = p.encode(text or "")
        bytes_a = [bytes(shown[ord(c)] for c in t.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in map(p.id_to_piece, ids_b)]
        if not text or b"".join(bytes_a) != b"".join(bytes_b) or b"".join(bytes_a) != (" " + text).encode():
            rows.append(([], [], "", []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        place_a, place_b = ({e: n + 1 for n, e in enumerate(x)} for x in (end_a, end_b))
        both = set(end_a) & set(end_b)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(both):
            k, m = place_a[end], place_b[end]
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            links += [(ids_a[x], ids_b[y]) for x in range(i, k) for y in range(j, m) if end_a[x] == end_b[y]]
            i, j = k, m
        rows.append((ids_a, ids_b, ";".join(groups), links))
        counts.update(links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, g, k in rows]


@pytest.mark.parametrize("heavy", [65_536, 50])
def test_alignment_against_a_plain_version(spark, documents, rows, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    got = alignment.cross_align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    ids, texts = [r[0] for r in rows] + [1000 + i for i in range(len(ODD))], [r[1] for r in rows] + ODD
    want = Counter((i, *w) for i, w in zip(ids, plain_alignment(texts), strict=True))
    assert Counter(map(tuple, got.collect())) == want
    assert sum(w[3] for w in want.elements()) > 1000
    clash = docs.withColumnsRenamed({}).selectExpr("doc_id", "text", "1 AS pairs", "2 AS row", "3 AS n_a")
    assert alignment.cross_align(clash, A, B).count() == len(ids)
    assert alignment.cross_align(docs.limit(0), A, B).collect() == []


def test_components_are_the_smallest_groups():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n)) for _ in range(2))
        group_a, group_b, met, with_ = alignment.aligned(np.arange(len(a)), np.arange(len(b)), a, b)
        ends = sorted(set(a.tolist()) & set(b.tolist()))
        assert group_a.tolist() == [sum(e < x for e in ends) for x in a] and group_b.tolist() == [sum(e < x for e in ends) for x in b]
        assert [(a[x], b[y]) for x, y in zip(met, with_, strict=True)] == [(e, e) for e in ends]
    assert alignment.union_find(6, np.asarray([5, 3, 4]), np.asarray([3, 1, 0])).tolist() == [0, 1, 2, 1, 0, 1]


PAGE = "<html><head>{}</head><body>text</body></html>"
SITES = [
    (1, "http://a.example.net/es/1", PAGE.format('<link rel="canonical" href="https://b.example.org/es/x">')),  # to a blocked address that is no page
    (2, "http://c.example.net/p", PAGE.format('<META http-equiv=Refresh content="0; URL=http://a.example.net/es/1#top">')),
    (3, "http://d.example.net/q/r", PAGE.format("<link rel='nofollow Canonical' href='../q2?x=1&amp;y=2'>")),
    (4, "http://d.example.net/q2?x=1&y=2", PAGE.format('<link href="//c.example.net/p" rel=canonical>')),
    (5, "https://x.example.org/fr/1", PAGE.format('<link rel="canonical" href="http://c.example.net/p">')),  # explicitly allowed
    (6, "https://y.example.net/1", PAGE.format('<link rel="canonical" href="https://x.example.org/fr/2">')),
    (7, "https://y.example.net/2", PAGE.format('<!-- <link rel="canonical" href="http://c.example.net/p"> --><script>var a = \'<link rel="canonical" href="http://c.example.net/p">\'</script>')),
    (8, "https://y.example.net/3", PAGE.format('<link rel="stylesheet canonicals" href="http://c.example.net/p"><a href="http://c.example.net/p">canonical</a>')),
    (9, "https://EXAMPLE.org/EN/1", "canonical"),
    (10, "https://sub.example.org/en/12?x", ""),
    (11, "notexample.org/en/1", None),
    (12, None, PAGE.format('<link rel="canonical" href="http://c.example.net/p">')),
    (13, "http://example.com/de/", PAGE.format('<meta http-equiv="refresh" content="5">')),
    (14, "http://example.com/fr/?a=://b.org/", "x" * 100_000),
    (15, "http://z.example.net", PAGE.format('<link rel="canonical" href="http://z.example.net/#a"><link rel="canonical" href="mailto:me@example.com">')),
    (16, "http://z.example.net/./a/../b/..", PAGE.format('<link rel=canonical href=http://example.com/de/7>')),
    (17, "http://z.example.net/", None),
    (18, "http://c.example.net/p", None),
    (None, "http://c.example.net/p", None),
    (18, "http://c.example.net/p", None),
    (19, "ftp://host.org", "<link rel=canonical href=?q>"),
    (20, "x://", "<link rel=canonical href=y>"),
]


def test_blocks_reach_aliases_and_allows_go_first(spark):
    pages = spark.createDataFrame([(*s, "c", 1) for s in SITES], "page_id bigint, url string, html string, component string, id int")
    got = [tuple(r) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()]
    verdict = {r[0]: r[4:] for r in got}
    assert all(verdict[i] == ("block", "alias") for i in (1, 2, 3, 4, 16, 17, 18, None)) and len(got) == len(SITES)
    assert verdict[5] == ("allow", "rule") and all(verdict[i] == ("allow", None) for i in (6, 7, 8, 11, 12, 20))
    assert {r[0]: r[3] for r in got if r[3]} == {5: "org/", 9: "org/", 10: "example.org/en/1", 13: "com/de/", 14: "com/fr/"}
    assert {r[0]: r[1:3] for r in got}[9] == ("example.org", "/EN/1") and {r[0]: r[1:3] for r in got}[11] == ("", "")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", SITES)
    assert Counter(con.sql(url_filter.judge_sql(queries.URL_RULES)).fetchall()) == Counter(got)
    moved = spark.createDataFrame([("http://old.example.net/a", "/b"), ("http://old.example.net/b", "http://example.com/de/1"), (None, "x"), ("y", None)], "source string, target string")
    one = spark.createDataFrame([(1, "http://old.example.net/a", None)], "page_id bigint, url string, html string")
    assert url_filter.judge_urls(one, queries.URL_RULES, moved).first()["verdict"] == "block"
    assert url_filter.judge_urls(one, [], moved).first()["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).collect() == []
    for bad in (lambda: url_filter.Rule("maybe", "a", "/"), lambda: url_filter.judge_urls(one, [url_filter.Rule("allow", f"h{i}", "/") for i in range(1001)])):
        with pytest.raises(ValueError):
            bad()


def test_long_chains_and_hubs_of_aliases(spark):
    chain = [(i, f"http://c.example.net/{i}", PAGE.format(f'<link rel="canonical" href="/{i + 1}">')) for i in range(60)]
    hub = [(1000 + i, f"http://h{i}.example.net/", PAGE.format('<link rel="canonical" href="http://c.example.net/30">')) for i in range(300)]
    free = [(2000 + i, f"http://f{i}.example.net/", PAGE.format('<link rel="canonical" href="http://free.example.net/">')) for i in range(100)]
    end = [(3000, "http://c.example.net/60", PAGE.format('<meta http-equiv="refresh" content="0;url=http://example.com/de/">'))]
    pages = spark.createDataFrame(chain + hub + free + end, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert got == {i: "allow" if 2000 <= i < 3000 else "block" for i in got} and len(got) == 461


def plain_importance(rows, target, percent, least):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = word.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_importance_against_a_plain_version(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(importance, "SEGMENT", 64)
    more = [(2000 + i, t) for i, t in enumerate(ODD)] + [(3000, "A1 b-2_Ünï\u0080x 日本 Z" * 9), (3001, "Baba REti " * 30)]
    docs = documents.select("doc_id", "text", "id", "rank", "key").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([(1, "Baba reti onel mu, baba RETI"), (2, None), (3, "")], "item_id bigint, text string")
    for percent, least in ((5, 20), (60, 3)):
        got = importance.importance_resample(docs, target, percent=percent, least_words=least)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        want = plain_importance([r[:2] for r in rows] + more, ["Baba reti onel mu, baba RETI"], percent, least)
        assert Counter(map(tuple, got.collect())) == want
    drawn = importance.resampled_documents(docs, target, percent=60, least_words=3)
    assert drawn.columns == docs.columns and Counter(r.doc_id for r in drawn.collect()) == Counter(w[0] for w in want.elements() if w[4])
    assert importance.importance_resample(docs.limit(0), target).collect() == []
    assert importance.importance_resample(docs, target.limit(0), percent=100).where("rank IS NOT NULL").count() > 20


def test_parts_of_a_text_come_to_the_same_as_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    letters = list("ab eé.,'\"s<>|_-0123\n\t  ▁日😀Ωß ") + ["the ", " of ", "ing", "  ", "n't ", "<s> ", "<0x41> ", "don't", " ▁▁ "]
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(600)]
    rows = lambda: [(*r[:5], list(r[5]), list(r[6])) for r in alignment.align_texts(texts, A, B, alignment.Remembered(most=50))]
    parted = rows()
    monkeypatch.setattr(alignment, "BORDER", re.compile("(?!)"))
    assert parted == rows() and sum(r[0] > 0 for r in parted) > 150
    assert sum(r[0] == 0 for r in parted) > 20  # the sign of a space in a text


def test_parts_encoded_together_are_as_alone(monkeypatch):
    """Plain parts are encoded in one text: parts that are not given back, special strings and others with marks among them."""
    rng = random.Random(5)
    parts = [prose(rng, 1) + rng.choice(["", ",", ".", "'s", "é"]) for _ in range(1500)]
    parts += ["Ĳx", "ſa", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "á", "x\ny", "", "\ta", "b\t", "z" * 3000, "世界", "'ll", "1234567", "..."]
    parts = list(dict.fromkeys(parts))
    rng.shuffle(parts)
    asked = []
    encode = alignment.ByteLevel.encode
    monkeypatch.setattr(alignment.ByteLevel, "encode", lambda self, texts: asked.extend(texts) or encode(self, texts))
    together = alignment.align_parts(parts, A, B)
    assert len(asked) < 30
    assert together == [alignment.align_parts([p], A, B)[0] for p in parts]
    # a run of which an encoding doesn't give a part back is encoded part by part
    pieces = alignment.Pieces.encode
    monkeypatch.setattr(alignment.Pieces, "encode", lambda self, texts: [[] if "zz" in t else ids for t, ids in zip(texts, pieces(self, texts), strict=True)])
    lost = [p for p, found in zip(parts, alignment.align_parts(parts, A, B), strict=True) if not found[0]]
    assert set(lost) == {"", "z" * 3000}
    assert [f for p, f in zip(parts, alignment.align_parts(parts, A, B), strict=True) if p not in lost] == [f for p, f in zip(parts, together, strict=True) if p not in lost]
