"""Alignment of two tokenizers' encodings: union-find over overlapping tokens, links inside the groups, counts of id pairs.

Tokens of both encodings are intervals of the same bytes. Two tokens of different encodings that overlap are an edge of a
bipartite graph; its connected components are exactly the smallest runs of tokens that both encodings cut out alike. Within
a component, members whose bytes end together are linked. How often an id pair is linked is counted over all documents
with partial sums; documents then look their pairs up: the few pairs that hold most links go to all tasks, the rest is
joined by a shuffle in which no pair is large.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain, compress

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, map_rows, written
from .packing import Remembered

#: A pair with at least this share of all links goes to all tasks; so there are at most as many as the inverse.
HEAVY = 65_536
#: Bytes of texts that are encoded and aligned at once.
PORTION = 1 << 22
#: A space before which both encodings end a token: it stands alone between marks, digits or letters up to U+024F.
BORDER = re.compile("(?<=[!-~\u00c0-\u024f]) (?=[!-~\u00c0-\u024f])")
#: A part that stands between such spaces whatever comes before and after it.
PLAIN = re.compile("[!-~\u00c0-\u024f]+")
#: Parts that are encoded as one text.
TOGETHER = 512
#: Characters of the longest part that is remembered.
LONGEST = 64
GROUP_SCHEMA = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' sets after uniting ``left`` with ``right``.

    All edges hang the larger of their roots under the smaller at once, then all paths are halved until they are flat, in
    turn until no edge joins two roots.
    """
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    return root


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens that share bytes, of two encodings of the same bytes given by where their tokens end."""
    cuts = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)] if len(cuts) else cuts
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, places of the A tokens of links, places of their B tokens).

    Groups are numbered in the bytes' order. A component's members are linked where their bytes end together.
    """
    left, right = overlaps(ends_a, ends_b)
    root = union_find(len(ids_a) + len(ids_b), left, right + len(ids_a))
    group = (np.cumsum(root == np.arange(len(root))) - 1)[root]
    group_a, group_b = group[: len(ids_a)], group[len(ids_a) :]
    at = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
    met = np.flatnonzero((ends_b[at] == ends_a) & (group_b[at] == group_a)) if len(ends_b) else np.empty(0, dtype=np.int64)
    return group_a, group_b, met, at[met]


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; it encodes a space and the text, special strings as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.inner.no_truncation()
        self.inner.no_padding()
        # printable bytes stand for themselves, the others for characters from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.bytes = [b""] * self.inner.get_vocab_size(with_added_tokens=True)
        for token, i in self.inner.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.inner.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.inner.id_to_piece, range(self.inner.get_piece_size())))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1)


@cache
def coder(path: str) -> ByteLevel | Pieces:
    """A tokenizer of this worker, loaded once."""
    import os

    # a task has one core
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@cache
def written_ids(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a tokenizer's tokens in bytes, and their ids as text with each of the marks that may follow: , | ;"""
    known = coder(path).bytes
    texts = np.empty((len(known), 3), dtype=object)
    for i in range(len(known)):
        texts[i] = [f"{i},", f"{i}|", f"{i};"]
    return np.asarray([len(b) for b in known], dtype=np.int64), texts


@cache
def remembered(path_a: str, path_b: str) -> Remembered:
    """What parts come to, kept by the worker from task to task."""
    return Remembered()


@kept_by_worker
def forget() -> None:
    for held in (coder, written_ids, remembered):
        held.cache_clear()


@cache
def parts_stand_alone(path: str) -> bool:
    """Whether no piece of a sentencepiece model goes on with a space after another character: then no token crosses a
    single space between two characters from the left."""
    return all("▁" not in p.lstrip("▁") for p in map(coder(path).inner.id_to_piece, range(len(coder(path).bytes))))


def given_back(parts: list[str], plain: int, path_a: str, path_b: str) -> tuple[np.ndarray, ...]:
    """(ids_a, ids_b, n_a, n_b) of parts, one after another; a part that an encoding doesn't give back has none.

    The first ``plain`` parts are plain. They are encoded together with single spaces between them, where both encodings end a token. Where these parts
    are not given back, or a token goes over such a border, and with all other parts, each is encoded alone.
    """
    a, b = coder(path_a), coder(path_b)
    size_a, size_b = written_ids(path_a)[0], written_ids(path_b)[0]
    held: list[tuple[list[int], list[int]]] = []
    counts: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(data: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        return b"".join(map(a.bytes.__getitem__, ids_a)) == data and b"".join(map(b.bytes.__getitem__, ids_b)) == data

    def alone(few: list[str]) -> None:
        for text, ids_a, ids_b in zip(few, a.encode(few), b.encode(few), strict=True):
            good = whole(b" " + text.encode(), ids_a, ids_b)
            held.append((ids_a, ids_b) if good else ([], []))
            counts.append((np.asarray([len(held[-1][0])]), np.asarray([len(held[-1][1])])))

    plain = plain if parts_stand_alone(path_b) else 0
    runs = [parts[i : min(i + TOGETHER, plain)] for i in range(0, plain, TOGETHER)]
    texts = [" ".join(run) for run in runs]
    for run, text, ids_a, ids_b in zip(runs, texts, a.encode(texts), b.encode(texts), strict=True):
        if whole(b" " + text.encode(), ids_a, ids_b):
            ends = np.cumsum([len(p.encode()) + 1 for p in run])
            ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
            upto_a, upto_b = np.searchsorted(ends_a, ends, side="right"), np.searchsorted(ends_b, ends, side="right")
            if (ends_a[upto_a - 1] == ends).all() and (ends_b[upto_b - 1] == ends).all():
                held.append((ids_a, ids_b))
                counts.append((np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)))
                continue
        alone(run)
    alone(parts[plain:])
    ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in zip(*held, strict=True))
    n_a, n_b = (np.concatenate(n) for n in zip(*counts, strict=True))
    return ids_a, ids_b, n_a, n_b


def align_parts(parts: list[str], path_a: str, path_b: str) -> list[tuple]:
    """(n_a, n_b, n_groups, groups, pairs of the links) of each part; zeros where an encoding doesn't give the bytes back.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``; a pair is a * 2^32 + b, as 8 bytes.
    """
    out: list[tuple] = [(0, 0, 0, "", b"")] * len(parts)
    if not parts:
        return out
    (size_a, text_a), (size_b, text_b) = written_ids(path_a), written_ids(path_b)
    other = np.asarray([PLAIN.fullmatch(p) is None for p in parts])
    places = np.argsort(other, kind="stable")
    ids_a, ids_b, n_a, n_b = given_back([parts[i] for i in places.tolist()], len(parts) - int(other.sum()), path_a, path_b)
    if not len(ids_a):
        return out
    whole = np.flatnonzero(n_a)
    places, n_a, n_b = places[whole].tolist(), n_a[whole], n_b[whole]
    # one after another the parts are one text: a part's end is an end of both encodings
    group_a, group_b, met, with_ = aligned(ids_a, ids_b, np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]))
    # a mark follows each id: a comma, at the end of a group's A ids a bar, at the end of its B ids a semicolon
    mark_a, mark_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    mark_a[np.append(np.flatnonzero(np.diff(group_a)), len(ids_a) - 1)] = 1
    mark_b[np.append(np.flatnonzero(np.diff(group_b)), len(ids_b) - 1)] = 2
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    marked = np.concatenate((text_a[ids_a, mark_a], text_b[ids_b, mark_b]))[order].tolist()
    pairs = ((ids_a[met] << 32) + ids_b[with_]).tobytes()
    end_a, end = np.cumsum(n_a), np.cumsum(n_a + n_b).tolist()
    end_group, end_pair = group_a[end_a - 1] + 1, 8 * np.searchsorted(met, end_a)
    tokens = group = pair = 0
    for at, x, y, upto, to_group, to_pair in zip(places, n_a.tolist(), n_b.tolist(), end, end_group.tolist(), end_pair.tolist(), strict=True):
        out[at] = x, y, to_group - group, "".join(marked[tokens:upto])[:-1], pairs[pair:to_pair]
        tokens, group, pair = upto, to_group, to_pair
    return out


def align_texts(texts: list[str | None], path_a: str, path_b: str, known: Remembered) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each text; ``times`` counts a pair's links in the text.

    Texts that one of the encodings does not give back byte by byte have no tokens. Both encodings end a token before a
    single space between two plain characters, so no component crosses it: a text is cut there, and what a part comes to
    is remembered, up to a bounded number of parts, of which long ones are none. What the different parts come to is added
    up for all texts at once.
    """
    cut = BORDER.split if parts_stand_alone(path_b) else lambda text: [text]
    split = [cut(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(split))
    if not flat:
        return [(0, 0, 0, 0, "", [], [])] * len(texts)
    place = {p: i for i, p in enumerate(dict.fromkeys(flat))}
    got = list(map(known.get, place))
    unknown = [g is None for g in got]
    new = list(compress(place, unknown))
    for part, what in zip(new, align_parts(new, path_a, path_b), strict=True):
        got[place[part]] = what
        if len(part) <= LONGEST:
            known.put(part, what)
    n_a, n_b, n_groups, groups, links = zip(*got, strict=True)
    at = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
    bounds = np.cumsum([0, *map(len, split)])

    def added(of: np.ndarray) -> np.ndarray:
        """Sums over each text's parts."""
        return np.diff(np.concatenate(([0], np.cumsum(of)))[bounds])

    n_a, n_b, n_groups, n_links = (np.asarray(n, dtype=np.int64)[at] for n in (n_a, n_b, n_groups, list(map(len, links))))
    n_links //= 8
    none = (added(n_a == 0) > 0) | (np.diff(bounds) == 0)
    # the links of the different parts one after another; each part of a text takes its stretch of them
    every = np.frombuffer(b"".join(links), dtype=np.int64)
    first = np.cumsum([0, *map(len, links)])[at] // 8
    pairs = every[np.repeat(first - (np.cumsum(n_links) - n_links), n_links) + np.arange(n_links.sum())]
    ends = np.concatenate(([0], np.cumsum(n_links)))[bounds].tolist()
    sums = zip(*(added(n).tolist() for n in (n_a, n_b, n_groups, n_links)), strict=True)
    out, at, bounds, written_as = [], at.tolist(), bounds.tolist(), groups.__getitem__
    for i, (numbers, nothing) in enumerate(zip(sums, none.tolist(), strict=True)):
        if nothing:
            out.append((0, 0, 0, 0, "", [], []))
        else:
            out.append((*numbers, ";".join(map(written_as, at[bounds[i] : bounds[i + 1]])), *np.unique(pairs[ends[i] : ends[i + 1]], return_counts=True)))
    known.tidy()
    return out


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document (id, n_a, n_b, n_groups, n_links, groups, pairs, times), as ``align_texts`` gives them.

    Whole texts of any length; null and empty ones have no tokens. Rows keep their multiplicity, ids may be null or
    repeated. Other columns are ignored, whatever their names.
    """

    def rows(batches):
        known = remembered(path_a, path_b)
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["data"].to_pylist()
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size + len(texts[to] or "") <= PORTION):
                    size += len(texts[to] or "")
                    to += 1
                found = align_texts(texts[at:to], path_a, path_b, known)
                n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*found, strict=True)
                yield {"id": ids[at:to], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "pairs": pairs, "times": times}
                at = to

    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"CAST(`{text_column}` AS STRING) AS data")
    return map_rows(slim, rows, GROUP_SCHEMA, slice_rows=1024)


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, n, best) over all aligned documents: links that hold the pair, and whether no pair of its B id has more."""
    each = documents.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return counts.select("pair", "n", (F.col("n") == top).alias("best"))


def cross_align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the document's links whose pair is linked as often as any pair of its B id in the whole corpus, count_sum
    adds up how often the links' pairs are linked in the corpus; groups_sha256 is the digest of the groups' text, empty
    without tokens. Nulls, empty and long texts, repeated rows and an empty table as for ``align_documents``.
    """
    aligned_ = align_documents(docs, path_a, path_b, id_column, text_column)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    # a number for each row, settled by being written
    held = written(aligned_.withColumn("groups_sha256", sha).drop("groups").withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = written(pair_counts(held), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * F.lit(HEAVY) >= F.lit(total)).orderBy("pair").collect()
    pairs = np.asarray([r["pair"] for r in common], dtype=np.int64)
    n, best = np.asarray([r["n"] for r in common], dtype=np.int64), np.asarray([r["best"] for r in common], dtype=np.int64)

    def looked_up(batches):
        """A row a document for what the common pairs add, and a row for each other pair."""
        for batch in batches:
            out = {"row": [], "pair": [], "times": [], "n_best": [], "count_sum": []}
            for row, own, times in zip(batch["row"].to_pylist(), batch["pairs"].to_pylist(), batch["times"].to_pylist(), strict=True):
                own, times = np.asarray(own or [], dtype=np.int64), np.asarray(times or [], dtype=np.int64)
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                known = pairs[at] == own if len(pairs) else np.zeros(len(own), dtype=bool)
                where, rare = at[known], own[~known]
                out["row"] += [row] * (len(rare) + 1)
                out["pair"] += [None, *rare.tolist()]
                out["times"] += [0, *times[~known].tolist()]
                out["n_best"] += [int((times[known] * best[where]).sum()), *[0] * len(rare)]
                out["count_sum"] += [int((times[known] * n[where]).sum()), *[0] * len(rare)]
            yield out

    types = "row bigint, pair bigint, times bigint, n_best bigint, count_sum bigint"
    parts = written(map_rows(held.select("row", "pairs", "times"), looked_up, types, slice_rows=1024), "alignment-parts")
    rare = parts.where("pair IS NOT NULL").select("row", "pair", "times").join(counts, "pair")
    rare = rare.select("row", (F.col("times") * F.col("best").cast("bigint")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = parts.where("pair IS NULL").select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return held.join(sums, "row").select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
