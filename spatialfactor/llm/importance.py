"""Importance resampling towards a target: documents are drawn by how much more often their word runs occur in the target.

A feature is a run of one to ``width`` words, known by a bucket of its CRC. One scan of a document keeps the running CRC
states of the last starts in a ring: a word opens a state, and each state in the ring is extended by a space and the word.
No feature is ever put together as a string, and the memory of a scan is the ring and a segment of words. Corpus and target
are counted per task into arrays of one number a bucket; what tasks send on, and the gains that they get back, is bounded by
the number of buckets, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import positions
from .common import map_rows, written

#: Bytes to letters, digits and bytes of other scripts as they are, A to Z lowered, all else a space.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Bytes of a text whose words are cut out at once.
SEGMENT = 1 << 20


def word_runs(data: bytes, width: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them), a segment of the text at a time."""
    clean, ring, at, keep = data.translate(FOLD), [], 0, width - 1
    while at < len(clean):
        end = clean.find(b" ", at + SEGMENT)
        end = len(clean) if end < 0 else end
        words, states = clean[at:end].split(), []
        for word in words:
            more = b" " + word
            ring = [crc32(word), *[crc32(more, state) for state in ring[:keep]]]
            states += ring
        yield len(words), np.asarray(states, dtype=np.uint32) % np.uint32(buckets)
        at = end


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all rows of ``texts`` (data) fall into each bucket."""

    def rows(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data in batch["data"].to_pylist():
                for _, found in word_runs(data or b"", width, buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield {"bucket": held, "n": counts[held]}

    out = np.zeros(buckets, dtype=np.int64)
    for r in map_rows(texts, rows, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share of the target to that of the source, one added to each count."""
    size, whole, aimed = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    return np.asarray([math.floor(1000 * math.log(float(target[b] + 1) * whole / (float(source[b] + 1) * aimed))) for b in range(size)], dtype=np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, width: int) -> DataFrame:
    """(id, row_id, n_words, n_features, weight) of rows (id, row_id, data): the sum of the gains over a row's features."""

    def rows(batches):
        for batch in batches:
            out = []
            for data in batch["data"].to_pylist():
                n = features = weight = 0
                for words, found in word_runs(data or b"", width, len(gains)):
                    n, features, weight = n + words, features + len(found), weight + int(gains[found].sum())
                out.append((n, features, weight))
            n, features, weight = zip(*out, strict=True) if out else ((), (), ())
            yield {"id": batch["id"], "row_id": batch["row_id"], "n_words": n, "n_features": features, "weight": weight}

    return map_rows(docs, rows, "id bigint, row_id bigint, n_words bigint, n_features bigint, weight bigint", slice_rows=256)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, width: int = 3, buckets: int = 10_000, seed: int = 42, least_words: int = 20, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
    """Per document: n_features, weight, score and rank; ``percent`` of the documents with ``least_words`` words are drawn.

    The score is the weight plus Gumbel noise that hangs on the seed and the id alone, so the highest scores are a draw
    without replacement with odds by exp(weight / 1000). Ranks follow scores, ties go to the smaller id; what is not drawn
    has none. Whole texts of any length count. Null and empty texts have no features, weight 0, and are never drawn. Rows
    keep their multiplicity; repeated rows share a score and take ranks one after another. The noise of a null id is that
    of an empty one, and it comes last among equals. An empty corpus gives no rows; without target every gain tells only
    how often a bucket is in the corpus. Other columns are ignored, whatever their names; ``row_column`` (a number) is
    passed through as row_id.

    Two scans read the texts; ranks are positions in rows dealt by ranges of the score, so no task gets all of them.
    """
    row = f"CAST(`{row_column}` AS BIGINT)" if row_column else "CAST(NULL AS BIGINT)"
    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"{row} AS row_id", f"CAST(`{text_column}` AS BINARY) AS data")
    aimed = target.selectExpr(f"CAST(`{text_column}` AS BINARY) AS data")
    gains = bucket_gains(bucket_counts(slim.select("data"), width, buckets), bucket_counts(aimed, width, buckets))
    drawn_by = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn_by + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(importance_weights(slim, gains, width).withColumn("score", F.col("weight") + noise), "importance")
    fits = F.col("n_words") >= least_words
    take = percent * scored.where(fits).count() // 100
    placed = positions(scored, [], [fits.desc(), F.col("score").desc(), F.col("id").asc_nulls_last()])
    rank = F.when(fits & (F.col("position") <= take), F.col("position"))
    out = placed.select(F.col("id").alias(id_column), "n_features", "weight", "score", rank.alias("rank"), "row_id")
    return out if row_column else out.drop("row_id")


def resampled_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with all of their columns. A row number, settled by being written, leads back to them."""
    keyed = written(docs.withColumn("importance_row", F.monotonically_increasing_id()), "importance-rows")
    drawn = importance_resample(keyed, target, row_column="importance_row", **settings).where("rank IS NOT NULL")
    return keyed.join(drawn.select(F.col("row_id").alias("importance_row")), "importance_row").select(docs.columns)
