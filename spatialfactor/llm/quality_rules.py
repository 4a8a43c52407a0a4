"""Quality rules: exact counts of a text, and an isolation forest over statistics made of them.

A rule statistic is how far a measure of a document lies outside the range that labelled rows of good quality have, with
a margin; it is 0 inside. The forest splits a statistic at random between its least and greatest value, again and again;
a document that few splits set apart is unlike the rest. All labelled rows count: every second row of either label gives
the ranges, as exact quantiles, and is what trees draw from; all others settle, as hold-out, the score from which on a
document is rejected. A tree of 256 rows drawn at random is the method's own (Liu, Ting and Zhou): it bounds no input.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import positions, prefix_sums, quantiles
from .common import map_rows, written

#: Bytes of UTF-8 that are word separators, counted symbols, capitals, digits, and that continue a code point.
SEPARATORS, SYMBOLS, CAPITALS, DIGITS, LETTERS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(65, 91)) + bytes(range(97, 123))
CONTINUING = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Quantiles of good rows that make a range.
RANGE = (0.001, 0.5, 0.999)
STATISTICS = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated_words", "capitals", "digits", "marks", "distinct_words", "line_words")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words which the text holds twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def measure(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The exact counts of a whole text in UTF-8, and the statistics that the forest sees."""
    words = data.split()
    without = lambda drop: len(data) - len(data.translate(None, drop))
    white, symbols = without(SEPARATORS), without(SYMBOLS)
    chars = len(data.translate(None, CONTINUING)) - white
    lines = [x for x in data.split(b"\n") if x.strip()]
    duplicates, repeats, n = len(lines) - len(set(lines)), repeated_words(words), len(words)
    counts = n, chars, symbols, duplicates, repeats
    if not n:
        return counts, (0.0,) * len(STATISTICS)
    letters, capitals, digits = without(LETTERS), without(CAPITALS), without(DIGITS)
    other = len(data) - white - letters - digits - without(bytes(range(0x80, 256)))
    return counts, (
        float(np.log1p(n)),
        min(chars / n, 100.0),
        symbols / n,
        duplicates / len(lines),
        repeats / n,
        capitals / max(letters, 1),
        digits / max(chars, 1),
        other / n,
        len(set(words)) / n**0.8,
        float(np.log1p(n / len(lines))),
    )


@dataclass
class Forest:
    """Isolation trees as arrays: split statistic (-1 at a leaf), split value, left child, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    expected: float
    depth: int
    low: np.ndarray
    high: np.ndarray
    scale: np.ndarray

    def score(self, measures: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected length) of each row: near 1 for outliers, below 0.5 for the bulk."""
        rows = outside(measures, self.low, self.high, self.scale)
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, value, left, length in zip(self.feature, self.value, self.left, self.length, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                split = feature[node]
                if (inner := split >= 0).any():
                    right = rows[at, np.maximum(split, 0)] >= value[node]
                    node = np.where(inner, left[node] + right, node)
                else:
                    break
            total += length[node]
        return np.exp2(-total / len(self.feature) / self.expected)


def unsuccessful(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def outside(measures: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """How far each measure lies outside its range, in widths of the range, at most 4; negative below it."""
    return np.clip((np.maximum(measures - high, 0) + np.minimum(measures - low, 0)) / scale, -4, 4)


def ranges(low: np.ndarray, mid: np.ndarray, high: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, greatest value and width: the quantiles moved out by ``margin`` of their distance from the median."""
    low, high = low - margin * (mid - low), high + margin * (high - mid)
    return low, high, np.maximum(high - low, 0.05)


def draw(n: int, trees: int, sample: int, rng: np.random.Generator) -> list[np.ndarray]:
    """For each tree the numbers of ``sample`` different rows of ``n``, or of all where there are fewer."""
    return [rng.choice(n, min(sample, n), replace=False) for _ in range(trees)]


def grow_trees(drawn: list[np.ndarray], low: np.ndarray, high: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> Forest:
    """A tree of the measures of each draw."""
    trees, size = len(drawn), len(drawn[0])
    depth = max(1, int(np.ceil(np.log2(max(size, 2))))) + 2
    nodes = 2 ** (depth + 1)
    feature, value = np.full((trees, nodes), -1, dtype=np.int64), np.zeros((trees, nodes))
    left, length = np.zeros((trees, nodes), dtype=np.int64), np.zeros((trees, nodes))
    for t in range(trees):
        work, free = [(0, outside(drawn[t], low, high, scale), 0)], 1
        while work:
            node, part, level = work.pop()
            least, most = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(most > least)
            if level == depth or len(part) < 2 or not len(varied):
                length[t, node] = level + unsuccessful(len(part))
                continue
            k = rng.choice(varied)
            feature[t, node], value[t, node], left[t, node] = k, rng.uniform(least[k], most[k]), free
            right = part[:, k] >= value[t, node]
            work += [(free, part[~right], level + 1), (free + 1, part[right], level + 1)]
            free += 2
    return Forest(feature, value, left, length, max(unsuccessful(size), 1.0), depth, low, high, scale)


def grow_forest(measures: np.ndarray, good: np.ndarray, trees: int = 100, sample: int = 256, margin: float = 0.5, seed: int = 17) -> Forest:
    """A forest of rows at hand: ranges from the good ones, a tree of each draw of ``sample`` rows."""
    rng = np.random.default_rng(seed)
    bounds = ranges(*np.quantile(measures[good], RANGE, axis=0), margin)
    return grow_trees([measures[at] for at in draw(len(measures), trees, sample, rng)], *bounds, rng)


def settle_threshold(scores: np.ndarray, good: np.ndarray, most_lost: float) -> float:
    """The score above which documents go: the cut that parts good from bad labels best among those that reject at most
    ``most_lost`` of the good ones. Infinite where a label is missing."""
    if not good.any() or good.all():
        return float("inf")
    cuts = np.unique(scores)
    lost = 1.0 - np.searchsorted(np.sort(scores[good]), cuts, side="right") / good.sum()
    caught = 1.0 - np.searchsorted(np.sort(scores[~good]), cuts, side="right") / (~good).sum()
    allowed = lost <= most_lost
    gain = np.where(allowed, caught - lost, -1.0)
    best = int(np.argmax(gain))
    return float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2)


def best_cut(scored: DataFrame, most_lost: float) -> float:
    """``settle_threshold`` for any number of rows (label, score): only distinct scores are put in order, over ranges."""
    by_score = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("bad"))
    by_score = written(by_score, "quality-scores")
    total = by_score.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return float("inf")
    below = prefix_sums(by_score, [], [F.col("score")], F.col("good"), "good_below")
    below = prefix_sums(below, [], [F.col("score")], F.col("bad"), "bad_below")
    lost = 1.0 - (F.col("good_below") + F.col("good")) / F.lit(float(total["good"]))
    caught = 1.0 - (F.col("bad_below") + F.col("bad")) / F.lit(float(total["bad"]))
    best = below.select("score", lost.alias("lost"), caught.alias("caught")).where(F.col("lost") <= most_lost)
    best = best.orderBy((F.col("caught") - F.col("lost")).desc(), "score").first()["score"]
    after = by_score.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return float((best + (best if after is None else after)) / 2)


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, the counts and the statistics. One pass over whole texts, no shuffle."""

    def rows(batches):
        for batch in batches:
            got = [measure(d or b"") for d in batch["data"].to_pylist()]
            yield {"id": batch["id"], **{k: [c[i] for c, _ in got] for i, k in enumerate(COUNTS)}, "stats": [s for _, s in got]}

    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"CAST(`{text_column}` AS BINARY) AS data")
    return map_rows(slim, rows, "id bigint, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", stats array<double>")


def scores(forest: Forest, stats) -> np.ndarray:
    """The forest's scores of an Arrow array of statistics."""
    return forest.score(stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)))


def fit_measured(rows: DataFrame, labels: DataFrame, most_lost: float = 0.002, id_column: str = "doc_id", label_column: str = "quality", trees: int = 100, sample: int = 256, margin: float = 0.5, seed: int = 17) -> tuple[Forest | None, float]:
    """Forest and threshold from all labelled rows of what ``measured`` gives.

    An id counts once, with the least of its labels. The odd places of either label by id give ranges and draws, the
    even ones the threshold. The driver gets quantiles and the rows drawn, at most ``sample`` a tree. Without good rows
    there is no forest; without bad ones the threshold is infinite.
    """
    ids = labels.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"CAST(`{label_column}` AS INT) AS label").where("id IS NOT NULL AND label IS NOT NULL")
    ids = ids.groupBy("id").agg(F.min("label").alias("label"))
    known = rows.join(ids, "id").groupBy("id").agg(F.min("label").alias("label"), F.min("stats").alias("stats"), F.max("n_words").alias("n_words"))
    known = known.where("n_words > 0").select("id", (F.col("label") == 1).cast("int").alias("label"), "stats")
    known = written(positions(known, ["label"], [F.col("id")], "place"), "quality-labelled")
    n_good, n_bad = (int(n or 0) for n in known.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    good, bad = (n_good + 1) // 2, (n_bad + 1) // 2
    if good < 8:
        return None, float("inf")
    grown = known.where("place % 2 = 1").withColumn("number", F.floor(F.col("place") / 2) + F.when(F.col("label") == 1, 0).otherwise(good))
    one = grown.where("label = 1").select(F.posexplode("stats").alias("k", "x"))
    found = {(r["k"], r["probability"]): r["quantile"] for r in quantiles(one, ["k"], F.col("x"), list(RANGE)).collect()}
    bounds = ranges(*(np.asarray([found[k, p] for k in range(len(STATISTICS))]) for p in RANGE), margin)
    rng = np.random.default_rng(seed)
    drawn = draw(good + bad, trees, sample, rng)
    wanted = np.unique(np.concatenate(drawn))
    asked = rows.sparkSession.createDataFrame([(int(n),) for n in wanted], "number bigint")
    got = {r["number"]: r["stats"] for r in grown.join(F.broadcast(asked), "number").select("number", "stats").collect()}
    stats = np.asarray([got[n] for n in wanted.tolist()])
    forest = grow_trees([stats[np.searchsorted(wanted, at)] for at in drawn], *bounds, rng)

    def score(batches):
        for batch in batches:
            yield {"label": batch["label"], "score": scores(forest, batch["stats"])}

    held = map_rows(known.where("place % 2 = 0").select("label", "stats"), score, "label int, score double", slice_rows=8192)
    return forest, best_cut(held, most_lost)


def fit_forest(docs: DataFrame, labels: DataFrame, most_lost: float = 0.002, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> tuple[Forest | None, float]:
    """Forest and threshold from all labelled documents."""
    return fit_measured(measured(docs, id_column, text_column), labels, most_lost, id_column, label_column)


def judge(rows: DataFrame, forest: Forest | None, threshold: float, id_column: str = "doc_id") -> DataFrame:
    """Per row of what ``measured`` gives: the counts, base_failed, kept and anomaly (the forest's score)."""

    def verdicts(batches):
        for batch in batches:
            n = batch["n_words"].to_numpy()
            score = scores(forest, batch["stats"]) if forest is not None else np.zeros(len(n))
            failed = (n < 10) | (100 * batch["n_repeat_words"].to_numpy() > 20 * n)
            yield {"id": batch["id"], **{k: batch[k] for k in COUNTS}, "base_failed": failed, "kept": ~failed & (score <= threshold), "anomaly": score}

    out = map_rows(rows, verdicts, "id bigint, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double", slice_rows=8192)
    return out.withColumnRenamed("id", id_column)


def apply_rules(docs: DataFrame, forest: Forest | None, threshold: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the counts, base_failed, kept and anomaly (the forest's score).

    A null text has no words and fails; ids may be null or repeated and rows keep their multiplicity; other columns are
    ignored, whatever their names; an empty table gives no rows. Without a forest a document that does not fail is kept.
    """
    return judge(measured(docs, id_column, text_column), forest, threshold, id_column)


def quality_rules(docs: DataFrame, labels: DataFrame, most_lost: float = 0.002) -> DataFrame:
    """Fit on all labelled rows, judge all documents. Texts are read once: what is measured is narrow and written."""
    rows = written(measured(docs), "quality-measures")
    return judge(rows, *fit_measured(rows, labels, most_lost))
