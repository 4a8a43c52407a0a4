"""Sparse matrices as tables of blocks, and their products with dense ones without shuffling either.

A stripe of a sparse matrix (row, column, value) is ``size`` of its columns. It becomes as many table rows, blocks, as it has
``BLOCK_ENTRIES``, and an entry goes to one by a hash of its row: blocks hold about as many entries each, however thin the
matrix is and whatever its ids. A block is compressed by those rows that it has. A dense matrix (id, k, value) becomes a table
row for ``size`` of its ids. Sparse tables are bucketed by their stripes and dense ones by their blocks of ids, into as many
buckets, so that a product reads both in place; only the products' rows, one for all components, are shuffled to be summed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..sources.store import delete, shared_folder
from .tiles import sent

SIZE = 1_024
#: Entries of a block.
BLOCK_ENTRIES = 1 << 15


@dataclass(frozen=True)
class BlockTable:
    """A bucketed table of blocks. ``names`` are the columns of the long form, ``ks`` a dense matrix's components."""

    name: str
    path: str
    size: int
    names: tuple[str, str, str]
    table: DataFrame
    ks: tuple[int, ...] = ()

    def drop(self) -> None:
        """Remove the table from the catalog and from disk."""
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(spark, self.path)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _kept(df: DataFrame, column: str, size: int, names: tuple[str, str, str], ks: tuple[int, ...] = ()) -> BlockTable:
    spark = df.sparkSession
    name, buckets = f"b{uuid.uuid4().hex}", _buckets(spark)
    path = f"{shared_folder(spark)}/blocks/{name}"
    df.repartition(buckets, column).write.option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    return BlockTable(name, path, size, names, spark.table(name), ks)


def compressed(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are there, where each one's entries start and the last ends, columns, sums of the values of a cell)."""
    order = np.lexsort((cols, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    cells = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])))
    rows, cols, vals = rows[cells], cols[cells], np.add.reduceat(vals, cells)
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[starts], np.append(starts, len(rows)).astype(np.int32), cols, vals


def to_blocks(entries: DataFrame, row: str = "obs_id", column: str = "var_id", value: str = "x", size: int = SIZE, block_entries: int = BLOCK_ENTRIES) -> BlockTable:
    """Blocks (rb, cb, rows, indptr, cols, vals) of entries; of repeated ones the sum, as in a sum of matrices. Entries with a
    null row or column are a ValueError, null values count as 0, zeros stay as they are."""
    if size < 1:
        raise ValueError("a block needs at least one row")
    spark = entries.sparkSession
    ship_package(spark)
    # made once: they are looked through for nulls, counted and dealt
    path = f"{shared_folder(spark)}/blocks/entries-{uuid.uuid4().hex}"
    slim = entries.select(F.col(row).cast("bigint").alias("r"), F.col(column).cast("bigint").alias("c"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    slim.write.parquet(path)
    try:
        one = spark.read.schema(slim.schema).parquet(path)
        if not one.where("r IS NULL OR c IS NULL").isEmpty():
            raise ValueError("every entry needs a row and a column")
        # whole numbers divide exactly, also below zero
        cells = one.select(((F.col("c") - F.pmod("c", F.lit(size))) / F.lit(size)).cast("bigint").alias("cb"), "r", F.pmod("c", F.lit(size)).cast("int").alias("c"), "v")
        counted = cells.groupBy("cb").agg(F.ceil(F.count("*") / F.lit(block_entries)).alias("blocks"))
        dealt = cells.join(sent(counted), "cb").select(F.pmod(F.xxhash64("r"), F.col("blocks")).alias("rb"), "cb", F.struct("r", "c", "v").alias("e"))
        blocks = dealt.groupBy("rb", "cb").agg(F.collect_list("e").alias("e"))

        def compress(frames):
            for f in frames:
                made = [compressed(*(np.asarray(x) for x in b)) for b in zip(f["r"], f["c"], f["v"], strict=True)]
                yield pd.DataFrame({"rb": f["rb"], "cb": f["cb"]} | {k: [m[i] for m in made] for i, k in enumerate(("rows", "indptr", "cols", "vals"))})

        unpacked = blocks.select("rb", "cb", F.col("e.r").alias("r"), F.col("e.c").alias("c"), F.col("e.v").alias("v"))
        return _kept(unpacked.mapInPandas(compress, "rb bigint, cb bigint, rows array<bigint>, indptr array<int>, cols array<int>, vals array<double>"), "cb", size, (row, column, value))
    finally:
        delete(spark, path)


def from_blocks(blocks: BlockTable) -> DataFrame:
    """The entries (row, column, value) of blocks."""
    row, column, value = blocks.names
    # a row's id for each of its entries, so that nothing but entries is carried along
    ids = "flatten(transform(rows, (r, i) -> array_repeat(r, indptr[i + 1] - indptr[i])))"
    spans = blocks.table.select("cb", F.expr(ids).alias("r"), F.col("cols").alias("c"), F.col("vals").alias("v")).select("cb", F.explode(F.arrays_zip("r", "c", "v")).alias("e"))
    return spans.select(F.col("e.r").alias(row), (F.col("cb") * F.lit(blocks.size) + F.col("e.c")).alias(column), F.col("e.v").alias(value))


def dense_blocks(factor: DataFrame, key: str = "obs_id", value: str = "w", size: int = SIZE) -> BlockTable:
    """Blocks (cb, ids, ks, values) of a dense matrix (id, k, value): the components in order, and each id's values, 0 where
    one is missing."""
    ks = sorted(r["k"] for r in factor.select("k").distinct().collect())
    order = F.array(*[F.lit(k).cast("int") for k in ks])
    wide = factor.groupBy(F.col(key).cast("bigint").alias("id")).agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col(value).cast("double"))), F.lit(0.0)).alias(f"v{k}") for k in ks])
    rows = wide.select(((F.col("id") - F.pmod("id", F.lit(size))) / F.lit(size)).cast("bigint").alias("cb"), F.struct(F.pmod("id", F.lit(size)).cast("int").alias("i"), F.array(*[F.col(f"v{k}") for k in ks]).alias("row")).alias("e"))
    blocks = rows.groupBy("cb").agg(F.sort_array(F.collect_list("e")).alias("e")).select("cb", F.col("e.i").alias("ids"), order.alias("ks"), F.flatten("e.row").alias("values"))
    return _kept(blocks, "cb", size, (key, "k", value), tuple(ks))


def multiply(sparse: BlockTable, dense: BlockTable, out: str = "v") -> DataFrame:
    """(row, k, out): the product of a sparse and a dense matrix, for the rows in which the sparse one has entries that meet
    ids of the dense one. The blocks' sizes must agree, a ValueError otherwise."""
    if sparse.size != dense.size:
        raise ValueError("the matrices have blocks of different sizes")
    size, ks = sparse.size, dense.ks
    # in place: both are bucketed by cb
    met = sparse.table.join(dense.table.hint("merge"), "cb").select("rows", "indptr", "cols", "vals", "ids", "values")
    columns = [f"v{i}" for i in range(len(ks))]

    def products(frames):
        for f in frames:
            for b in f.itertuples(index=False):
                r = len(ks)
                held, known = np.zeros((size, r)), np.zeros(size, dtype=bool)
                held[b.ids], known[b.ids] = np.asarray(b.values).reshape(-1, r), True
                indptr, cols, vals = np.asarray(b.indptr), np.asarray(b.cols), np.asarray(b.vals)
                row, own = np.repeat(np.arange(len(b.rows)), np.diff(indptr)), known[cols]
                row, cols, vals = row[own], cols[own], vals[own]
                if not len(row):
                    continue
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                sums = np.add.reduceat(vals[:, None] * held[cols], starts, axis=0)
                yield pd.DataFrame({"id": np.asarray(b.rows)[row[starts]]} | {c: sums[:, i] for i, c in enumerate(columns)})

    parts = met.mapInPandas(products, ", ".join(["id bigint", *[f"{c} double" for c in columns]]))
    whole = parts.groupBy(F.col("id").alias(sparse.names[0])).agg(*[F.sum(c).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("k"), F.col(c).alias("v")) for k, c in zip(ks, columns, strict=True)]).cast("array<struct<k: int, v: double>>"))
    return whole.select(sparse.names[0], each.alias("e")).select(sparse.names[0], "e.k", F.col("e.v").alias(out))
