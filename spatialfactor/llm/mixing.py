"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

A source's documents stand in a fixed order, each with the same expected number of copies, target / source size. The
expected copies are summed along the order, one random offset is added, and a document is emitted once for each integer
that the sum crosses at it. The order runs through the documents by size class (the leading two digits and the number of
digits of the size), within a class by a hash of the id, so that what is taken has nearly the sizes of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Weights of the sources in code point order, repeating; the null source comes last.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_COPIES = 3
#: Documents whose order is settled in one window; a source's size class is cut into hash ranges of about so many.
CELL_ROWS = 1_000


def hash32(value: Column) -> Column:
    """First 32 bits of the MD5 of a string, as bigint; Spark and other engines agree on it."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")


def size_class(size: Column) -> Column:
    """Number of decimal digits times 100 and the leading two digits: a size class spans at most a tenth of its sizes."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: the weights' share of all words, at most three times the source.

    Water filling: with the sources by size over weight, the first j are capped and the rest share what is left by
    weight, for the first j at which the next one is not above its cap. One row per source goes through one window.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_COPIES)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = caps.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    level = level.withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = level.withColumn("rate", F.col("left") / F.col("share"))
    # the first source by cap over weight that stays below its cap settles the rate; there is none if all are capped
    free = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("rate")))).over(whole)
    target = F.least(F.coalesce(free["rate"] * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", row_column: str | None = None) -> DataFrame:
    """Per document: size (words), source_size, target (words its source should give) and taken (words, repeats counted).

    Rows keep their multiplicity; equal rows may get different numbers of copies, as neighbours in the order. A null
    text has size 0 and nothing is taken of it; a null source is a source of its own, the last. Rows without id come first
    in their class, by size; those of one size are alike, so their order says nothing and they are dealt at random. A
    source without words has target 0. Other columns of ``docs`` are ignored, whatever their names; ``row_column``, which
    tells rows apart, is handed through.

    One pass over the texts writes the narrow rows (id, source, size) to the shared folder; three passes over those: sizes
    by source, cells (source, size class, size of rows without id, hash range) by count, and the rank within a cell. Sums
    are combined before the shuffle. No task holds a source: a cell holds about ``CELL_ROWS`` rows, the cells' counts are
    summed along a size class, and those of the classes along a source.
    """
    kept = [F.col(row_column).alias("row")] if row_column else []
    rows = docs.select(
        F.col(source_column).cast("string").alias("source"),
        F.col(id_column).cast("bigint").alias("doc"),
        word_count(F.col(text_column)).alias("size"),
        *kept,
    ).withColumn("class", size_class(F.col("size")))
    # random numbers are settled by being written
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32))
    rows = rows.withColumn("mark", F.coalesce(hash32(F.col("doc").cast("string")), chance))
    rows = rows.withColumn("anonymous", F.when(F.col("doc").isNull(), F.col("size")))
    rows = written(rows, "mixing-sizes")

    group = ("source", "class", "anonymous")
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    offset = hash32(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\u0000")))) / F.lit(4294967296.0)
    sources = source_targets(sizes).withColumn("offset", offset)
    # hash ranges of a group: as many as its count needs, all of the same width; the groups' counts along the source
    along = Window.partitionBy("source").orderBy("class", F.col("anonymous").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.select(*group, F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("bigint").alias("ranges"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("earlier"))
    celled = rows.alias("r").join(groups.alias("g"), _all("r", "g", group), "left")
    celled = celled.select("r.*", "g.earlier", F.floor(F.col("mark") * F.col("ranges") / F.lit(4294967296)).cast("bigint").alias("cell"))
    cells = celled.groupBy(*group, "cell").agg(F.count("*").alias("n"), F.min("earlier").alias("earlier"))
    along = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.col("earlier") + F.coalesce(F.sum("n").over(along), F.lit(0)))
    cells = cells.alias("c").join(sources.alias("s"), _all("c", "s", ("source",)), "left")
    cells = cells.select(*[f"c.{k}" for k in group], "c.cell", "c.before", "s.source_size", "s.target", "s.offset")

    within = Window.partitionBy(*group, "cell").orderBy("mark", "doc", "size")
    ranked = celled.withColumn("rank", F.row_number().over(within))
    out = ranked.alias("r").join(cells.alias("c"), _all("r", "c", (*group, "cell")), "left")
    rank = F.col("c.before") + F.col("r.rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("offset") + rate * rank) - F.floor(F.col("offset") + rate * (rank - 1))
    kept = [F.col("r.row").alias(row_column)] if row_column else []
    return out.select(F.col("r.doc").alias(id_column), F.col("r.size").alias("size"), "source_size", "target", (crossed * F.col("r.size")).cast("bigint").alias("taken"), *kept)


def _all(left: str, right: str, keys: tuple[str, ...]) -> Column:
    """Equality of keys that may be null."""
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return met


#: The same in DuckDB's SQL, over its view ``documents``.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents
), marked AS (
  SELECT *, length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT) AS class,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS mark
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM marked GROUP BY source
), caps AS (
  SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM sources
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0e0) AS share
  FROM caps WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT rest / share AS rate FROM levels WHERE rest / share * weight <= cap ORDER BY cap / weight, rest / share LIMIT 1
), targets AS (
  SELECT source, source_size, least(coalesce((SELECT rate FROM free) * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target,
    CAST('0x' || substr(md5('17:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) / 4294967296e0 AS start
  FROM caps
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, CASE WHEN doc_id IS NULL THEN size END NULLS LAST, mark, doc_id, size) AS rank FROM marked
)
SELECT doc_id, size, source_size, target,
  CAST((floor(start + CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END * rank)
      - floor(start + CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END * (rank - 1))) * size AS BIGINT) AS taken
FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
"""
