"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing takes the pieces from the longest to the shortest and puts each into the open sequence with the
least room that still holds it. Pieces of one length are alike and so are sequences with the same room, so the plan
needs only the number of pieces of each length: at most as many numbers as a sequence has tokens, whatever the size of
the corpus. The plan keeps open sequences by room, finds the tightest with a segment tree over rooms, and moves alike
pieces into alike sequences at once, with the same outcome as piece by piece. A piece then finds its place from its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, kept_by_worker, map_rows, written

#: Letters of U+00C0 to U+024F have one form each and lower one by one; ASCII marks but the apostrophe end a word.
LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Entries of a table of chunks or words that a worker remembers, and of the encoder's; there are two generations, the older one goes.
REMEMBERED, REMEMBERED_CHUNKS = 200_000, 300_000
#: Bytes of text that are taken apart at once; a longer text is taken alone.
SLICE_BYTES = 1 << 22
#: Pieces of one length whose order is settled in one window.
CELL_ROWS = 1_000


class RoomTree:
    """Segment tree over the rooms 0 to ``capacity``: which have open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        at = room + self.size
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def first(self, room: int) -> int | None:
        """The smallest room of at least ``room`` that has a sequence."""
        at = room + self.size
        if self.any[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing for ``counts`` pieces of each length.

    Returns steps (length, first rank, pieces, first sequence, pieces to a sequence, offset of the first) and the number
    of sequences. Ranks count from 0 within a length; a step's sequences follow one another. Each step uses up a run of
    alike sequences or the pieces of a length, so there are no more steps than rooms times lengths.
    """
    open_at: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
    tree, steps, opened = RoomTree(capacity), [], 0

    def put(room: int, first: int, n: int) -> None:
        open_at[room].append((first, n))
        if len(open_at[room]) == 1:
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.first(length)
            if room is None:
                each = capacity // length
                room, first, n = capacity, opened, -(-left // each)
                opened += n
            else:
                first, n = open_at[room].popleft()
                if not open_at[room]:
                    tree.set(room, False)
                each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                steps.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < n:
                put(room, first + full, n - full)
    return steps, opened


class Remembered:
    """A table of bounded size: when it is full it becomes the older generation, from which what is used moves back."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: str | bytes) -> bytes | None:
        if (found := self.new.get(key)) is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def put(self, key: str | bytes, value: bytes) -> None:
        self.new[key] = value

    def tidy(self) -> None:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the vocabulary's library gives them.

    The library drops white space and cuts texts there and between letters and marks, so a text is put together from its
    chunks, and a chunk that is a word and marks from the two. Arrow cuts a slice of texts into chunks and finds the
    different ones. Chunks and words seen before are looked up; new words go to the library's model in one call, past its
    normalizers, which leave lower-case letters of one form as they are, and its ids are cut after each token that ends a
    word. What else is new goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # the model's alphabet stands for bytes; ASCII letters stand for themselves
        self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        spaces = pre_tokenizers.WhitespaceSplit()
        self.ascii.pre_tokenizer = spaces
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.chunks = Remembered(REMEMBERED_CHUNKS)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes], model) -> None:
        """Ids of lower-case words of letters."""
        got = model.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids
        ids = np.asarray(got, dtype="<u4")
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) == len(words) and after[-1] == len(ids):
            data, ends = ids.tobytes(), (4 * after).tolist()
            self.chunks.new.update(zip(words, (data[a:b] for a, b in pairwise([0, *ends])), strict=True))
        else:
            self.chunks.new.update(zip(words, self.ids([w.decode() for w in words]), strict=True))

    def look_up(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of different chunks."""
        self.chunks.tidy()
        known, get = self.chunks.new, self.chunks.get
        cut, other = [], []
        ascii_words, latin_words, marks = set(), set(), set()
        for c in [c for c in chunks if c not in known and get(c) is None]:
            if c.isalpha():  # of bytes: ASCII letters only
                word, rest = c.lower(), b""
            else:
                word = c.rstrip(MARKS)
                rest = c[len(word) :]
                if word.isalpha():
                    word = word.lower()
                elif word.isascii() or not LATIN.fullmatch(text := word.decode("utf-8", "replace")):
                    other.append(c)
                    continue
                else:
                    word = text.lower().encode()
            if get(word) is None:
                (ascii_words if word.isascii() else latin_words).add(word)
            if rest and get(rest) is None:
                marks.add(rest)
            if rest or word != c:
                cut.append((c, word, rest))
        for words, model in ((ascii_words, self.ascii), (latin_words, self.latin)):
            if words:
                self.learn(list(words), model)
        whole = [*marks, *other]
        known.update(zip(whole, self.ids([c.decode("utf-8", "replace") for c in whole]), strict=True))
        for c, word, rest in cut:
            known[c] = known[word] + known[rest] if rest else known[word]
        return list(map(known.__getitem__, chunks))

    def encode(self, data: pa.Array) -> Iterator[bytes]:
        """Ids of each text in UTF-8; a null text is empty."""
        before = [0, *np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(), dtype=np.int64).tolist()]
        at = 0
        while at < len(data):
            upto = max(at + 1, bisect_right(before, before[at] + SLICE_BYTES) - 1)
            yield from self.encode_slice([t or b"" for t in data.slice(at, upto - at).to_pylist()])
            at = upto

    def encode_slice(self, texts: list[bytes]) -> list[bytes]:
        # lowering ASCII first is what the library does later, but for marks that join a capital (U+0300 to U+033F begin
        # with this byte) and special tokens
        texts = [t if b"\xcc" in t or b"<|" in t else t.lower() for t in texts]
        # Arrow's ASCII white space is that of bytes.split; nothing looks at the bytes as characters
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        bounds = cut.offsets.to_pylist()
        found = cut.values.dictionary_encode()
        pick = self.look_up(found.dictionary.view(pa.large_binary()).to_pylist()).__getitem__
        at = found.indices.to_numpy()
        return [b"".join(map(pick, at[a:b].tolist())) for a, b in pairwise(bounds)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@kept_by_worker
def forget() -> None:
    encoder.cache_clear()


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece of a document: piece, start, length, ids_crc32. A null text is empty and gives the end id alone."""

    def rows(batches):
        coder, end = encoder(vocabulary), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
            for key, ids in zip(batch["id"].to_pylist(), coder.encode(batch["data"]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
            yield out

    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"CAST(`{text_column}` AS BINARY) AS data")
    return map_rows(slim, rows, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", slice_rows=BATCH_ROWS)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; a row per piece.

    Columns: the id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit numbers), sequence_id, offset (its place there). Only documents longer than a sequence are cut.

    A null text is empty; ids may be null or repeated and each row is packed; other columns are ignored, whatever their
    names. An empty table gives no rows. Texts are read once: the pieces, which are narrow, are written to the shared
    folder. The driver gets the number of pieces by length, at most ``capacity`` rows. Ranks within a length are settled
    in cells of about ``CELL_ROWS`` rows, so no length, however common, meets in one task.
    """
    # random numbers deal pieces into cells, equal ones too; they are settled by being written
    pieces = cut_pieces(docs, vocabulary, capacity, end_id, id_column, text_column).withColumn("mark", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32)))
    pieces = written(pieces, "packing-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    steps, _ = best_fit_plan(counts, capacity)
    # rank of a piece among those of its length: cells by hash, in order, and the row's place in its cell
    ranges = np.ones(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        ranges[length] = -(-n // CELL_ROWS)
    cell = F.floor(F.col("mark") * F.element_at(F.lit([int(r) for r in ranges]), (F.col("length") + 1).cast("int")) / F.lit(4294967296)).cast("bigint")
    celled = pieces.withColumn("cell", cell)
    along = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = celled.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = before.select("length", "cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("mark", "id", "piece")
    ranked = celled.withColumn("place", F.row_number().over(within)).join(before, ["length", "cell"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank"))

    plan = np.asarray(steps, dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    firsts = np.searchsorted(plan[:, 0], np.arange(capacity + 2))

    def rows(batches):
        # a step is found by its length and first rank; ranks stay below 2^50
        keys = (plan[:, 0].astype(object) * (1 << 50) + plan[:, 1].astype(object)).astype(np.int64) if capacity < 1 << 13 else None
        for batch in batches:
            length, rank = (batch[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            if keys is not None:
                step = np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1
            else:
                step = np.asarray([firsts[k] + np.searchsorted(plan[firsts[k] : firsts[k + 1], 1], r, side="right") - 1 for k, r in zip(length, rank, strict=True)], dtype=np.int64)
            nth = rank - plan[step, 1]
            yield {
                **{k: batch[k] for k in ("id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": plan[step, 3] + nth // plan[step, 4],
                "offset": plan[step, 5] + nth % plan[step, 4] * length,
            }

    out = map_rows(ranked, rows, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", slice_rows=65536)
    return out.withColumnRenamed("id", id_column)
