"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic rows, compress
each window of a text, and the difference of the two lengths tells which kind the window resembles.

A window is a word between spaces, lower-cased, in two bytes a letter, so that a match takes far fewer bytes than the
letters that it stands for. Most of a toxic row is ordinary text too, so the toxic dictionary is trained on those windows of
toxic rows that recur there and that compress worse with the ordinary dictionary: the rows, without near copies of one
another, are dealt into folds, a dictionary is trained on each, and a window stays if those of most folds save bytes over
the ordinary one. Windows
of ordinary rows that the toxic dictionary takes better are added to the ordinary dictionary. A logistic model turns a
document's gains into a score; it and the cut are fitted on labelled rows that took no part in training.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache
from heapq import nsmallest
from itertools import chain

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, kept_by_worker, map_rows

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Letters of a window at most; longer words are cut into windows that overlap by half.
LETTERS = 32
#: Sizes of the dictionaries, at most: ordinary, toxic on whole texts, toxic on chosen windows.
ORDINARY_SIZE, FIRST_SIZE, TOXIC_SIZE = 400_000, 524_288, 16_384
#: Bytes of a compressed window that is one match, at most.
ONE_MATCH = 17
#: Bytes saved from which on a window of a toxic row trains the toxic dictionary, and one of an ordinary row the ordinary one.
CHOSEN = 3
FOLDS, FOLD_ROWS, ROUNDS = 8, 6, 3
#: Ordinary rows to a toxic one among the labelled rows that fit the model, at most.
ORDINARY_SHARE = 4
#: Words whose gains a worker remembers; all are forgotten when there are more.
REMEMBERED = 100_000
#: The cut at which a document counts as toxic.
CUT = 0.7


def words_of(text: str) -> list[str]:
    """Windows of a whole text: its words, long ones in overlapping pieces."""
    words = NOT_LETTERS.sub(" ", text.lower()).split()
    if max(map(len, words), default=0) <= LETTERS:
        return words
    return [w[i : i + LETTERS] for w in words for i in range(0, max(len(w) - LETTERS // 2, 1), LETTERS // 2)]


def wide(words: str) -> bytes:
    return f" {words} ".encode("utf-16-le", "surrogatepass")


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept for tests: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """The longest match anywhere in the dictionary, from three letters on, without frame fields."""
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTLAZY2, min_match=6, window_log=22, hash_log=19, chain_log=22, search_log=8, target_length=999, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    # the last bytes of a dictionary are not found
    held = zstandard.ZstdCompressionDict(dictionary + bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)


def lengths(dictionary: bytes, windows: list[bytes]) -> np.ndarray:
    """Bytes that each window takes with the dictionary."""
    out: list[int] = []
    for at in range(0, len(windows), 16_384):
        packed = compressor(dictionary).multi_compress_to_buffer(windows[at : at + 16_384], threads=1)
        out += [len(packed[i]) for i in range(len(packed))]
    return np.asarray(out, dtype=np.float64)


def gains(ordinary: bytes, toxic: bytes, words: list[str]) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, by window."""
    windows = [wide(w) for w in words]
    return lengths(ordinary, windows) - lengths(toxic, windows)


#: Gains by word for the model that this worker applies.
_known: dict[str, float] = {}
_known_of: list[int] = []


@kept_by_worker
def forget() -> None:
    compressor.cache_clear()
    _known.clear()
    _known_of.clear()


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    shift: float

    def scores(self, texts: list[str]) -> list[float]:
        """Scores from 0 to 1; each different word is compressed once."""
        key = zlib.crc32(self.toxic, zlib.crc32(self.ordinary))
        if _known_of != [key] or len(_known) > REMEMBERED:
            _known.clear()
            _known_of[:] = [key]
        cut = [words_of(t) for t in texts]
        new = sorted({w for ws in cut for w in ws} - _known.keys())
        _known.update(zip(new, gains(self.ordinary, self.toxic, new).tolist(), strict=True))
        x = np.asarray([features([_known[w] for w in ws]) for ws in cut]).reshape(len(texts), len(self.weights))
        return (1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.shift, -30.0, 30.0)))).tolist() if texts else []


def features(found: list[float]) -> list[float]:
    """Of a document: its two largest gains, how many windows gain, and their share."""
    high = sorted((g for g in found if g > 0), reverse=True)
    sure = sum(g >= CHOSEN for g in high)
    top = [np.log1p(g) for g in (*high[:2], 0.0, 0.0)]
    return [1.0, top[0], top[1], float(np.log1p(sure)), float(np.log1p(100.0 * sure / max(len(found), 1)))]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples; their last bytes where there are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8, f=20, accel=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def passages(texts: Iterable[str]) -> list[bytes]:
    """Whole texts in pieces of 200 letters, as the trainer takes them."""
    out = []
    for text in texts:
        data = wide(" ".join(words_of(text)))
        out += [data[i : i + 400] for i in range(0, len(data), 400)]
    return out


def toxic_dictionary(windows: list[str], size: int = TOXIC_SIZE) -> bytes:
    """Trained on the windows, and after that, nearest to the text, the windows themselves, the most frequent last."""
    often = Counter(windows)
    content = b"".join(wide(w) for w in sorted(often, key=lambda w: (often[w], w)))
    return (trained([wide(w) for w in windows], size // 4) + content)[-size:]


def different_rows(texts: list[str]) -> list[list[str]]:
    """Each text's different words; texts that are near copies of an earlier one are left out.

    Of the hashes of a text's places (a word and its neighbours) the four smallest are compared: copies share one.
    """
    out: list[list[str]] = []
    seen: set[int] = set()
    for text in texts:
        ws = ["", *words_of(text), ""]
        low = set(nsmallest(4, {zlib.crc32(" ".join(place).encode("utf-8", "surrogatepass")) for place in zip(ws, ws[1:], ws[2:], strict=False)}))
        if seen.isdisjoint(low):
            out.append(sorted(set(ws[1:-1])))
        seen |= low
    return out


def fit(rows: list[tuple[int, str, int]]) -> Model | None:
    """Model from labelled rows (id, text, toxic); None unless both labels are there on both sides."""
    parts: dict[tuple[bool, int], list[tuple[int, str]]] = {(side, label): [] for side in (False, True) for label in (0, 1)}
    for key, text, label in sorted(rows):
        # two thirds train the dictionaries, the rest settle the scores
        parts[zlib.crc32(f"{key}:".encode()) % 3 == 0, label].append((key, text))
    if not all(parts.values()):
        return None
    plain = [t for _, t in parts[False, 0]]
    rows_of = different_rows([t for _, t in parts[False, 1]])
    n = min(FOLDS, max(len(rows_of) // FOLD_ROWS, 1))
    windows = [list(chain.from_iterable(rows_of[f::n])) for f in range(n)]
    common = sorted({w for t in plain for w in words_of(t)})
    # windows that stand in one fold only recur nowhere
    seen = Counter(w for ws in windows for w in set(ws))
    several = sorted(w for w, n in seen.items() if n > 1 or len(windows) == 1)
    base = ordinary = trained(passages(plain), ORDINARY_SIZE)
    moved: set[str] = set()
    chosen, size = set(several), FIRST_SIZE
    for _ in range(ROUNDS):
        kept = [[w for w in own if w in chosen] for own in windows]
        whole = toxic_dictionary(list(chain.from_iterable(kept)), size)
        # ordinary windows that the toxic dictionary takes better go to the ordinary one
        moved |= {w for w, g in zip(common, gains(ordinary, whole, common), strict=True) if g >= CHOSEN}
        ordinary = base + b"".join(map(wide, sorted(moved)))
        # windows of toxic rows stay which the dictionaries of most folds take as one match, the ordinary one not
        plain_bytes, votes = lengths(ordinary, [wide(w) for w in several]), np.zeros(len(several), dtype=np.int64)
        for own in kept:
            toxic_bytes = lengths(toxic_dictionary(own, size), [wide(w) for w in several])
            votes += (toxic_bytes <= ONE_MATCH) & (plain_bytes - toxic_bytes >= CHOSEN)
        chosen, size = {w for w, n in zip(several, votes, strict=True) if w in chosen and 2 * n > len(windows)}, TOXIC_SIZE
    toxic = toxic_dictionary([w for own in windows for w in own if w in chosen])
    model = Model(ordinary, toxic, np.zeros(5), 0.0)
    texts = [t for label in (0, 1) for _, t in parts[True, label]]
    different = sorted({w for t in texts for w in words_of(t)})
    judged = dict(zip(different, gains(model.ordinary, model.toxic, different).tolist(), strict=True))
    x = np.asarray([features([judged[w] for w in words_of(t)]) for t in texts])
    y = np.repeat([0.0, 1.0], [len(parts[True, 0]), len(parts[True, 1])])
    model.weights = logistic(x, y)
    model.shift = float(np.log(CUT / (1 - CUT)) - best_cut(x @ model.weights, y))
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray, weight: float = 4.0) -> float:
    """The cut that leaves the fewest errors, an ordinary row taken for toxic counting ``weight`` times."""
    cuts = np.unique(z)
    cuts = np.concatenate(([cuts[0] - 1.0], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1.0]))
    wrong = weight * (len(y) - y.sum() - np.searchsorted(np.sort(z[y == 0]), cuts)) + np.searchsorted(np.sort(z[y == 1]), cuts)
    return float(cuts[int(np.argmin(wrong))])


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int, longest: int, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """(id, label, text): at most ``sample`` toxic and ``ORDINARY_SHARE`` times as many ordinary rows outside the held-out
    third, texts of at most ``longest`` characters.

    Those with the least hash of the id are taken; an id with several labels counts as toxic, one with several texts
    gives the least of them.
    """
    ids = labels.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("int").alias("label"))
    ids = ids.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.max("label").alias("label"))
    some = None
    for label in (0, 1):
        part = ids.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample if label else ORDINARY_SHARE * sample)
        some = part if some is None else some.union(part)
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(some), "id").where(F.length("text") <= longest).groupBy("id", "label").agg(F.min("text").alias("text"))


def fitted(rows: DataFrame) -> Callable[[list[str]], list[float]] | None:
    """A function that scores texts by the model of these rows; None where nothing can be learned.

    The bounded sample is fitted in one task, so that the driver only holds the finished dictionaries, some 600 KB.
    """

    def learn(batches):
        got = [row for batch in batches for row in zip(*(batch[k].to_pylist() for k in ("id", "text", "label")), strict=True)]
        yield {"model": [pickle.dumps(fit(got))]}

    kept = map_rows(rows.select("id", "text", "label").coalesce(1), learn, "model binary", slice_rows=4096).collect()
    model = pickle.loads(kept[0]["model"]) if kept else None
    return model.scores if model is not None else None


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 1000, longest: int = 10_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: held_out, score (0 to 1) and predicted (1 from 0.7 on).

    Only the text enters the score. A null text is empty, and a text without letters has no windows. Ids may be null
    (not held out) or repeated and rows keep their multiplicity; other columns are ignored. Without labelled rows of both
    kinds to learn from, every score is 0. The model is fitted on at most ``sample`` toxic and 4 times as
    many ordinary rows of at most ``longest`` characters, which bounds the dictionaries too: the ordinary one holds
    ``ORDINARY_SIZE`` bytes trained on passages and the windows moved to it, the toxic one ``TOXIC_SIZE`` bytes, the most
    frequent windows where there are more. Whole texts of any length are scored. No shuffle of documents.
    """
    score = fitted(labelled_rows(docs, labels, sample, longest, id_column, text_column))

    def rows(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            scores = score(texts) if score else [0.0] * len(texts)
            yield {"id": batch["id"], "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= CUT) for s in scores]}

    slim = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).withColumn("held_out", held_out(F.col("id")))
    out = map_rows(slim, rows, "id bigint, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_column)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 1000, longest: int = 10_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that score as toxic, in one pass; columns and other rows as they are.

    Rows with a null or empty text stay, as do repeated rows and rows without id; texts of any length are scored whole.
    Without labelled rows of both kinds nothing is dropped, and an empty table stays empty.
    """
    score = fitted(labelled_rows(docs, labels, sample, longest, id_column, text_column))
    if score is None:
        return docs

    def rows(batches):
        for batch in batches:
            scores = score([t or "" for t in batch[text_column].to_pylist()])
            keep = [i for i, s in enumerate(scores) if s < CUT]
            yield {k: v.take(keep) for k, v in batch.items()}

    return map_rows(docs, rows, ddl(docs))
