"""Quality rules, packing, personal data, token counts: against plain versions on small rows of every kind."""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spatialfactor.llm import packing, pii, quality_rules, token_counts
from spatialfactor.operators import order

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts_and_verdicts(spark, documents, rows):
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(104, 0), (None, 1)], "doc_id bigint, quality int")
    got = quality_rules.quality_rules(documents, labels)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = Counter((i, *plain_counts(t)) for i, t, _ in rows)
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got.where("kept").collect()} >= set(range(30))
    assert quality_rules.quality_rules(documents.limit(0), labels.limit(0)).count() == 0


def plain_score(forest, row):
    """Mean path of one row, tree by tree, node by node, as a score."""
    total = 0.0
    for feature, value, left, length in zip(forest.feature, forest.value, forest.left, forest.length, strict=True):
        node = 0
        while feature[node] >= 0:
            node = left[node] + int(row[feature[node]] >= value[node])
        total += length[node]
    return 2.0 ** (-total / len(forest.feature) / forest.expected)


def test_the_forest_rejects_what_the_base_rule_keeps(spark):
    """One row in twenty is odd, labelled or not, passes the base rule and goes by its statistics; ids are all odd numbers."""
    rng = random.Random(5)
    odd = lambda: " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in prose(rng, 60).split())
    rows = [(2 * i + 1, prose(rng, 60) if i % 20 else odd(), 7.0) for i in range(1000)]
    docs = spark.createDataFrame([*rows, (None, odd(), 7.0), (None, prose(rng, 60), 7.0), rows[20]], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(2 * i + 1, int(i % 20 > 0)) for i in range(1000) if i % 4 < 3], "doc_id bigint, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == 1003 and not any(r.base_failed for r in got)
    good, bad = [r.kept for r in got if r.n_symbols == 0], [r.kept for r in got if r.n_symbols > 0]
    assert len(bad) == 52 and not any(bad) and sum(good) >= 0.99 * len(good)
    forest, cut = quality_rules.fit_forest(docs, labels)
    scores = Counter()
    for _, text, _ in (*rows[:60], rows[20]):
        measures = quality_rules.measure(text.encode())[1]
        scores[round(plain_score(forest, quality_rules.outside(np.asarray(measures), forest.low, forest.high, forest.scale)), 9)] += 1
    first = {i for i, _, _ in rows[:60]}
    assert scores == Counter(round(r.anomaly, 9) for r in got if r.doc_id in first) and all(r.kept == (r.anomaly <= cut) for r in got)
    assert {r.kept for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {True}


@pytest.mark.parametrize("text", ["a b c d e f a b c d e", "x\nx\n\n \nx\ty\n", "é é é é é é é é", "#|<a\x0bb\x1cc", "1 2 3 4 5 " * 9])
def test_quality_counts_of_odd_texts(text):
    counts, _ = quality_rules.measure(text.encode())
    assert counts == plain_counts(text)


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    good = rng.normal(size=(900, 10))
    bad = rng.normal(size=(100, 10)) + np.eye(10)[2] * 40
    x, y = np.vstack((good, bad)), np.repeat([True, False], [900, 100])
    forest = quality_rules.grow_forest(x[::2], y[::2])
    score = forest.score(x[1::2])
    cut = quality_rules.settle_threshold(score, y[1::2], 0.01)
    assert (score[y[1::2]] <= cut).mean() >= 0.99 and (score[~y[1::2]] > cut).mean() > 0.95


def test_ranges_draws_and_threshold_come_from_all_labelled_rows(spark, monkeypatch):
    """9,000 labelled rows against NumPy over all of them; exact quantiles also where a group is too large for a task."""
    monkeypatch.setattr(order, "SMALL", 3000)
    monkeypatch.setattr(order, "SETTLED", 500)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 9)
    rows = [(i * 7919 % 9001 - 50, " ".join(word() + "#" * (i % 9 == 0) * rng.randint(0, 2) for _ in range(rng.randint(10, 30))), int(i % 9 > 0 or i % 5 == 0)) for i in range(9000)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(5), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    forest, cut = quality_rules.fit_forest(docs, labels, most_lost=0.05)
    rows.sort()
    measures, good = np.asarray([quality_rules.measure(t.encode())[1] for _, t, _ in rows]), np.asarray([q == 1 for _, _, q in rows])
    grown = np.where(good, np.cumsum(good), np.cumsum(~good)) % 2 == 1
    low, high, scale = quality_rules.ranges(*np.quantile(measures[grown & good], quality_rules.RANGE, axis=0), 0.5)
    for got, want in ((forest.low, low), (forest.high, high), (forest.scale, scale)):
        np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)
    assert cut == pytest.approx(quality_rules.settle_threshold(forest.score(measures[~grown]), good[~grown], 0.05), rel=1e-12) and cut < 1
    # the draws are of these rows too: a forest of all of them at hand is the same one
    x = np.vstack((measures[grown & good], measures[grown & ~good]))
    plain = quality_rules.grow_forest(x, np.arange(len(x)) < (grown & good).sum())
    np.testing.assert_allclose(plain.value, forest.value, rtol=1e-9, atol=1e-9)
    assert (plain.feature == forest.feature).all() and (plain.left == forest.left).all()


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        best = min(fits, key=lambda b: b[0], default=None)
        if best is None:
            bins.append(best := [capacity, []])
        best[0] -= n
        best[1].append(n)
    return Counter(sum(b[1]) for b in bins)


def test_plan_fills_sequences_as_best_fit_piece_by_piece_does():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(1, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 120)).tolist()
        steps, n = packing.best_fit_plan(dict(Counter(lengths)), capacity)
        filled = defaultdict(list)
        for length, first, pieces, sequence, each, offset in steps:
            for i in range(pieces):
                filled[sequence + i // each].append((offset + i % each * length, length))
        for held in filled.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
        assert n == len(filled) and Counter(sum(x for _, x in h) for h in filled.values()) == plain_best_fit(lengths, capacity)


def test_packing_whole_documents(documents, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(documents, path, capacity=64).collect()
    want = Counter()
    for key, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[key, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(documents.limit(0), path).count() == 0


def test_ids_of_odd_texts_are_the_library_s(monkeypatch):
    """Odd texts in small slices with a small table give the library's ids; plain words don't go through all of it."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    library = Tokenizer.from_file(path)
    odd = [*"aBcIJTHé ÉßǅİıKſΣς,.'!?-_<|>\t\n\x0b\x0c\x1c\x85\xa0\u2028 03٣ⅷ\u0331\u030c\u0307\u0308\u030aẞ\u212aÅ中\U0001f600\u200b×ǰẖ\ud7ff", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "The", "ÀB"]
    texts = [None, "", " ", "J\u030c T\u0308", *("".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)), None]
    monkeypatch.setattr(packing, "SLICE_BYTES", 60)
    coder = packing.Encoder(path)
    coder.chunks.most = 30
    got = list(coder.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary())))
    assert got == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]
    asked = []
    monkeypatch.setattr(coder, "ids", lambda texts, ids=coder.ids: asked.extend(texts) or ids(texts))
    text = " ".join(w.title() + rng.choice(("", ",", ".", "é")) for w in prose(rng, 500).split())
    assert [len(x) // 4 for x in coder.encode(pa.array([text.encode()] * 3, pa.binary()))] == 3 * [len(library.encode(text, add_special_tokens=False).ids)]
    assert not set(asked) - {",", "."}


def plain_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and (not 12 <= len(digits) <= 19 or sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_exact_patterns_against_regular_expressions():
    import random

    rng = random.Random(2)
    bits = ["1", "2", "25", "255", "300", ".", ".", "@", "@", "+", "-", " ", "(", ")", "a", "b.c", "%", "é", "4111111111111111", "\n", "٣", "_", "0"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data_query_and_redaction(documents, rows):
    got = {r.doc_id: r for r in pii.find_personal_data(documents).collect()}
    assert (got[107].n_email, got[107].n_ip, got[107].n_card, got[107].n_phone) == (1, 1, 1, 1)
    text = next(t for i, t, _ in rows if i == 107)
    assert got[107].spans.split(",")[0] == f"email:{text.index('me.now')}:{text.index(' or')}"
    assert len(pii.find_personal_data(documents).collect()) == len(rows)
    redacted = pii.redact_documents(documents)
    assert redacted.columns == documents.columns and redacted.count() == len(rows)
    masked = redacted.where("doc_id = 107").first()
    assert "[EMAIL]" in masked.text and "4111" not in masked.text and masked.n_chars == len(masked.text)


def test_the_field_adds_what_the_patterns_miss():
    texts = [f"call +1 (212) 555-{i:04d} or ip 10.0.{i}.1 card 4111 1111 1111 1111 at a{i}@b.example.com id {i}{i}77" for i in range(60)]
    field = pii.fit_field(texts)
    base, spans = pii.all_spans("card 4111.1111.1111.1111 here", field)
    assert not base and [pii.KINDS[k] for _, k, _ in spans] == ["card"]
    assert pii.all_spans("in 1999 and 2024, page 77", field)[1] == []
    island = pii.island_of("10.0.0.1")
    marginals, _ = field.marginals(island, field.scores(island))
    assert marginals.min() >= -1e-9 and marginals.sum() <= len(island.borders)


def every_cut(n, segments):
    """All ways to cut n atoms into plain ones and segments: lists of the segments' numbers."""
    if n == 0:
        return [[]]
    return every_cut(n - 1, segments) + [cut + [s] for s, (i, j, _) in enumerate(segments) if j == n for cut in every_cut(i, segments)]


def test_marginals_and_best_cut_against_all_cuts():
    from itertools import product

    texts = [f"call +1 (212) 555-{i:04d} or ip 10.0.{i}.1 key token = ab12cd34ef56{i:02d} at a{i}@b.example.com" for i in range(30)]
    field = pii.fit_field(texts)
    for text in ("10.0.0.1", "a1@b.c", "+1 (2", "7", "x9 8"):
        island = pii.island_of(text)
        scores, n = field.scores(island), len(island.borders) - 1
        weights = {}
        for cut in every_cut(n, island.segments):
            for kinds in product(range(len(pii.KINDS)), repeat=len(cut)):
                weights[tuple(zip(cut, kinds, strict=True))] = sum(scores[s, k] for s, k in zip(cut, kinds, strict=True))
        total = np.log(sum(np.exp(w) for w in weights.values()))
        marginals, log_sum = field.marginals(island, scores)
        assert np.isclose(log_sum, total)
        want = np.zeros_like(marginals)
        for cut, w in weights.items():
            for s, k in cut:
                want[s, k] += np.exp(w - total)
        assert np.allclose(marginals, want)
        best = max(weights, key=weights.get)
        got = {(a, k, b) for a, k, b, _ in field.decode(island)}
        assert got == {(island.borders[island.segments[s][0]], k, island.borders[island.segments[s][1]]) for s, k in best} or np.isclose(weights[best], 0)


def test_secrets_without_a_name_and_long_texts():
    rng = np.random.default_rng(4)
    value = lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))
    texts = [f"some words token = {value()} and more, version 3.0 of {2000 + i}" for i in range(60)]
    field = pii.fit_field(texts)
    secret = value()
    long = "word " * 400_000 + f'the token = "{secret}" ' + "1999 " * 300_000 + "me@x.example.com"
    base, spans = pii.all_spans(long, field)
    at = long.index(secret)
    assert [k for _, k, _ in base] == [0] and (at, pii.SECRET, at + 40) in spans and len(spans) == 2
    assert pii.redact(f"token = {secret}.", pii.all_spans(f"token = {secret}.", field)[1]) == "token = [SECRET]."


BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [8_193, 100_000])
def test_prefix_counts_behind_long_units(n):
    tokenizer, counter = Tokenizer.from_file(BYTES), token_counts.counter(BYTES)
    text = "q" * n + "<|endoftext|>x"
    want = [len(tokenizer.encode(text[:p], add_special_tokens=False).ids) for p in range(n, len(text) + 1)]
    assert counter.prefixes(text)[n:] == want


def test_counts_at_every_prefix():
    import random

    rng, tokenizer, counter = random.Random(3), Tokenizer.from_file(BYTES), token_counts.counter(BYTES)
    bits = ["a", "b", "'", "'s", "'re", " ", "  ", "\n", "\t", "é", "漢", "\U0001f600", "23", "!", "...", "<|endoftext|>", "\x1c", "\xa0", "the", "ing", " don't"]
    for _ in range(120):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        want = [len(tokenizer.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert counter.prefixes(text) == want, text
        assert counter.count(text) == want[-1]


def test_token_counts_of_documents(documents, rows):
    tokenizer = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(documents, BYTES, limit=50)
    want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    by_id = {i: t or "" for i, t, _ in rows}
    for r in got.where("over_limit").collect():
        assert r.n_tokens > 50 and len(tokenizer.encode(by_id[r.doc_id][: r.limit_chars], add_special_tokens=False).ids) <= 50
