"""Canonical views over the driver's tables: observations are parts, features suppliers, samples brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: View name: (views and tables it reads, SQL that Spark and DuckDB both run).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_obs": (
        ("part",),
        "SELECT p_partkey AS obs_id, p_name AS obs_name, p_brand AS sample_id, p_type AS cohort, CAST(p_size AS DOUBLE) AS x, p_retailprice / CAST(20 AS DOUBLE) AS y, p_retailprice FROM part",
    ),
    "fx_var": (("supplier",), "SELECT s_suppkey AS var_id, s_name AS var_name FROM supplier"),
    "fx_expr": (("lineitem",), "SELECT l_partkey AS obs_id, l_suppkey AS var_id, SUM(l_quantity) AS x FROM lineitem GROUP BY l_partkey, l_suppkey"),
    "fx_w": (
        ("part", "orders", "lineitem"),
        """SELECT o.obs_id, c.k, COALESCE(t.w, CAST(0 AS DOUBLE)) AS w
FROM (SELECT p_partkey AS obs_id FROM part) o
CROSS JOIN (SELECT DISTINCT CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 1 AS k FROM orders) c
LEFT JOIN (SELECT l_partkey AS obs_id, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 1 AS k, SUM(l_quantity) / CAST(100 AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 1) t
ON o.obs_id = t.obs_id AND c.k = t.k""",
    ),
    "fx_q": (
        ("lineitem", "orders"),
        """SELECT l_suppkey AS var_id, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 1 AS k, SUM(ROUND(l_discount * 100, 0) - 5) / CAST(COUNT(*) * 100 AS DOUBLE) AS q
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 1""",
    ),
    "fx_signatures": (
        ("supplier", "nation", "region"),
        """SELECT r_name AS signature, s_name AS gene, s_acctbal / CAST(1000 AS DOUBLE) AS avg_logfc, CAST(s_suppkey % 100 AS DOUBLE) AS pct_1, CAST(s_suppkey % 7 AS DOUBLE) AS pct_2
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "fx_wc": (
        ("fx_w", "fx_obs"),
        """SELECT w.obs_id, w.k,
  CASE w.k WHEN 0 THEN w.w + 1 WHEN 1 THEN w.w * w.w * w.w
    WHEN 2 THEN CASE WHEN CAST(SUBSTR(o.sample_id, 7) AS INT) <= 12 THEN w.w ELSE CAST(0 AS DOUBLE) END
    WHEN 3 THEN CASE WHEN w.obs_id % 2 = 0 THEN w.w + 1 ELSE w.w / 20 END
    ELSE CASE WHEN CAST(SUBSTR(o.sample_id, 7) AS INT) <= 3 THEN w.w * w.w ELSE CAST(0 AS DOUBLE) END END AS w
FROM fx_w w JOIN fx_obs o ON w.obs_id = o.obs_id""",
    ),
    "fx_qc": (("fx_q",), "SELECT var_id, k, q + CASE WHEN var_id % 5 = k THEN CAST(5 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS q FROM fx_q"),
}


def _activities(part: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The rows of ``fx_w``: its few components go to the observations, which Spark takes for the smaller side (they are so
    in a compressed file) and would send round; and a row of W is summed as one, so no observation is shuffled per component."""
    k = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("k")
    ks = orders.select(k).distinct()
    priorities = orders.select("o_orderkey", k)
    of_lines = lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(priorities.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = of_lines.groupBy("l_partkey", "k").agg((F.sum("l_quantity") / F.lit(100.0)).alias("w"))
    rows = sums.where("k IS NOT NULL").groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("row"))
    met = part.select(F.col("p_partkey").alias("obs_id")).join(rows.hint("merge"), F.col("obs_id") == F.col("l_partkey"), "left").select("obs_id", "row")
    return met.crossJoin(F.broadcast(ks)).select("obs_id", "k", F.coalesce(F.try_element_at("row", "k"), F.lit(0.0)).alias("w"))


#: Views whose Spark plan is written out, since the one that Spark makes of their SQL does not hold at size.
PLANS = {"fx_w": _activities}


def needed(names: tuple[str, ...]) -> list[str]:
    """The views that the given ones read, directly or not, each after those that it reads."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for below in VIEWS[name][0]:
                add(below)
            out.append(name)

    for name in names:
        add(name)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view as a DataFrame."""
    below, sql = VIEWS[name]
    frames = {b: view(spark, sf_dir, b) if b in VIEWS else spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in below}
    if name in PLANS:
        return PLANS[name](*(frames[b] for b in below))
    for b in frames:
        sql = _replaced(sql, b)
    return spark.sql(sql, **frames)


def _replaced(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def with_views(sql: str) -> str:
    """DuckDB SQL with the canonical views that it names in front of it."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in needed(tuple(used)))
    body = sql.strip()
    if not heads:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{heads}, {body.removeprefix(start)}"
    return f"WITH {heads} {body}"
