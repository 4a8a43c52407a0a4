"""Exact top-k by integer inner product: KD-trees per shard, searched best first.

Space is cut into cells by the median splits of a small KD-tree of a sample; a cell's vectors, dealt by a hash of the id
into blocks of bounded size, are shards. A shard's vectors are split at the median of their widest dimension down to leaves; each node keeps the tight box of its
vectors. No vector in a box scores above the sum, over the dimensions, of the larger of the query's products with the
box's two ends. A query visits nodes by falling bound and stops where the bound is below the k-th score that it has. Each
query first searches the shard of its own vector; the k-th score found there goes with it to the other shards, but only
to those of cells whose tight box reaches it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, written

LEAF, SHARD_ROWS = 64, 32_768
#: Rows of a cell, about, until there are ``MOST_CELLS``; vectors of the sample that cuts the cells, for each of them.
CELL_ROWS, MOST_CELLS, CELL_SAMPLE = 4096, 1024, 32
#: Numbers in the boxes of all cells, at most: what each task that routes queries holds.
BOX_NUMBERS = 1 << 20
#: The cell of vectors whose length is not the most common one; it has no box.
ODD = -1
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Vectors and ids in tree order, and nodes: boxes, the first child (0 at a leaf), ranges of vectors."""

    vectors: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: list[int]
    range: list[tuple[int, int]]


def build(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.argsort(ids, kind="stable")
    child, ranges, lows, highs = [0], [(0, len(ids))], [None], [None]
    work = [0]
    while work:
        node = work.pop()
        a, b = ranges[node]
        part = vectors[order[a:b]]
        lows[node], highs[node] = part.min(axis=0), part.max(axis=0)
        wide = int(np.argmax(highs[node] - lows[node]))
        if b - a <= leaf or lows[node][wide] == highs[node][wide]:
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, wide], half)]
        child[node] = len(child)
        for r in ((a, a + half), (a + half, b)):
            work.append(len(child))
            child.append(0)
            ranges.append(r)
            lows.append(None)
            highs.append(None)
    return Tree(vectors[order], ids[order], np.asarray(lows), np.asarray(highs), child, ranges)


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores, best first, of its k best vectors that reach the known score; its own id is
    left out."""
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    out = []
    for q, me, least, bound in zip(queries, own, known, bounds, strict=True):
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if first := tree.child[node]:
                for c in (first, first + 1):
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = tree.range[node]
            got = tree.vectors[a:b] @ q
            take = (got >= least) & (tree.ids[a:b] != me)
            if take.any():
                ids, scores = np.concatenate((ids, tree.ids[a:b][take])), np.concatenate((scores, got[take]))
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, scores.min())
        best = np.lexsort((ids, -scores))[:k]
        out.append((ids[best], scores[best]))
    return out


def search_large(vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, me: int, k: int) -> tuple[list[int], list[int]]:
    """The same in unbounded integers, for components whose products double precision can't hold; scores that a long
    can't hold are cut to its range."""
    exact = [int(x) for x in q]
    scored = sorted((-sum(a * int(b) for a, b in zip(exact, v, strict=True)), int(i)) for v, i in zip(vectors, ids, strict=True) if i != me)[:k]
    return [i for _, i in scored], [max(-LONG - 1, min(LONG, -s)) for s, _ in scored]


def cut_cells(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits of the widest dimensions, as a full binary tree in breadth-first order: dimensions and thresholds."""
    dims, at = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    parts = {0: sample}
    for node in range(len(dims)):
        part = parts.pop(node)
        if len(part):
            dims[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            at[node] = np.median(part[:, dims[node]])
        above = part[:, dims[node]] > at[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~above], part[above]
    return dims, at


def cell_of(vectors: np.ndarray, dims: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(vectors), dtype=np.int64)
    every = np.arange(len(vectors))
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (vectors[every, dims[node]] > at[node])
    return node - len(dims)


def whole(values: list) -> np.ndarray:
    return np.floor(1024.0 * np.asarray(values, dtype=np.float64))


def _placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Vectors (id, x, cell) and their most common length."""
    common = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length, n = (common["length"], common["count"]) if common else (1, 0)
    depth = 0
    while depth < 30 and CELL_ROWS << depth < n and 1 << depth < MOST_CELLS and (2 << depth) * 2 * length <= BOX_NUMBERS:
        depth += 1
    if not depth:
        return rows.withColumn("cell", F.when(F.size("x") == length, F.lit(0)).otherwise(F.lit(ODD))), length
    sample = rows.where(F.size("x") == length).orderBy(F.xxhash64("id"), "id").limit(CELL_SAMPLE << depth).collect()
    dims, at = cut_cells(whole([r["x"] for r in sample]), depth)

    def place(batches):
        for batch in batches:
            x = batch["x"].to_pylist()
            usual = [i for i, v in enumerate(x) if len(v) == length]
            cells = np.full(len(x), ODD, dtype=np.int32)
            if usual:
                cells[usual] = cell_of(whole([x[i] for i in usual]), dims, at)
            yield {"id": batch["id"], "x": batch["x"], "cell": cells}

    return map_rows(rows, place, "id bigint, x array<double>, cell int", slice_rows=4096), length


def _boxes(placed: DataFrame) -> dict[int, tuple[int, np.ndarray | None, np.ndarray | None]]:
    """Of each cell the number of its rows and the tight box of its vectors, none for those of other lengths.

    Tasks reduce their own rows first; the driver gets a row a cell, ``BOX_NUMBERS`` numbers in all at most.
    """

    def merge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            n = batch["n"].to_pylist() if "n" in batch else [1] * len(batch["cell"])
            cells = batch["cell"].to_numpy(zero_copy_only=False)
            low, high = (batch[k if k in batch else "x"].to_pylist() for k in ("low", "high"))
            for cell in np.unique(cells):
                mine = np.flatnonzero(cells == cell)
                total = sum(n[i] for i in mine)
                if cell == ODD:
                    held.setdefault(ODD, [0, None, None])[0] += total
                    continue
                a, b = np.asarray([low[i] for i in mine]).min(axis=0), np.asarray([high[i] for i in mine]).max(axis=0)
                got = held.setdefault(int(cell), [0, a, b])
                held[int(cell)] = [got[0] + total, np.minimum(got[1], a), np.maximum(got[2], b)]
        if held:
            yield {"cell": list(held), "n": [h[0] for h in held.values()], "low": [h[1] if h[1] is None else h[1].tolist() for h in held.values()], "high": [h[2] if h[2] is None else h[2].tolist() for h in held.values()]}

    types = "cell int, n bigint, low array<double>, high array<double>"
    parts = map_rows(placed.select("cell", "x"), merge, types, slice_rows=4096)
    found = map_rows(parts.repartition("cell"), merge, types, slice_rows=512).collect()
    return {r["cell"]: (r["n"], None if r["low"] is None else whole(r["low"]), None if r["high"] is None else whole(r["high"])) for r in found}


def _routed(queries: DataFrame, boxes: dict, blocks: dict[int, int]) -> DataFrame:
    """Queries (id, x, known, cell, block) for each shard but their own whose cell's box reaches the k-th score so far."""
    usual = sorted(c for c in boxes if c != ODD)
    low, high = (np.asarray([boxes[c][k] for c in usual]) for k in (1, 2))

    def rows(batches):
        for batch in batches:
            ids, xs, known, cells, own = (batch[k].to_pylist() for k in ("id", "x", "known", "cell", "block"))
            out: dict[str, list] = {k: [] for k in ("id", "x", "known", "cell", "block")}
            for i, x, least, cell, block in zip(ids, xs, known, cells, own, strict=True):
                if cell == ODD:
                    reached = [ODD]
                else:
                    q = whole(x)
                    bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                    # a bound beyond 2^53 is rounded; then a little more than it is let through
                    reached = usual if least is None else [usual[j] for j in np.flatnonzero(bound + 1e-12 * np.abs(bound) >= least)]
                shards = [(c, b) for c in reached for b in range(blocks[c]) if (c, b) != (cell, block)]
                out["id"] += [i] * len(shards)
                out["x"] += [x] * len(shards)
                out["known"] += [least] * len(shards)
                out["cell"] += [c for c, _ in shards]
                out["block"] += [b for _, b in shards]
            yield out

    return map_rows(queries.select("id", "x", "known", "cell", "block"), rows, "id bigint, x array<double>, known double, cell int, block int", slice_rows=64)


def _searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, vec_id, score) of queries (id, x, cell, block, known) among the vectors (id, x, cell, block)."""
    both = vectors.select("cell", "block", F.lit(0).alias("kind"), "id", "x", F.lit(None).cast("double").alias("known"))
    both = both.unionByName(queries.select("cell", "block", F.lit(1).alias("kind"), "id", "x", "known"))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")

    def rows(batches):
        shard, held, trees = None, [], {}

        def grow():
            by_size: dict[int, list] = {}
            for i, x in held:
                by_size.setdefault(len(x), []).append((i, x))
            held.clear()
            for size, group in by_size.items():
                data = whole([x for _, x in group])
                trees[size] = build(data, np.asarray([i for i, _ in group], dtype=np.int64)), np.abs(data).max()

        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            asked: dict[int, list] = {}

            def answer():
                for size, group in asked.items():
                    if size not in trees:
                        continue
                    tree, largest = trees[size]
                    q = whole([x for _, x, _ in group])
                    own, known = np.asarray([i for i, _, _ in group], dtype=np.int64), np.asarray([-np.inf if b is None else b for _, _, b in group])
                    if np.abs(q).max() * largest * size < EXACT:
                        got = search(tree, q, own, known, k)
                    else:
                        got = [search_large(tree.vectors, tree.ids, one, me, k) for one, me in zip(q, own, strict=True)]
                    for me, (ids, scores) in zip(own, got, strict=True):
                        found[0].extend([int(me)] * len(ids))
                        found[1].extend(int(i) for i in ids)
                        found[2].extend(int(s) for s in scores)
                asked.clear()

            for cell, block, kind, i, x, known in zip(*(batch[c].to_pylist() for c in ("cell", "block", "kind", "id", "x", "known")), strict=True):
                if (cell, block) != shard:
                    answer()
                    shard = cell, block
                    held.clear()
                    trees.clear()
                if kind == 0:
                    held.append((i, x))
                else:
                    if held:
                        grow()
                    asked.setdefault(len(x), []).append((i, x, known))
            answer()
            yield {"query_id": found[0], "vec_id": found[1], "score": found[2]}

    return map_rows(both, rows, "query_id bigint, vec_id bigint, score bigint", slice_rows=4096)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def exact_top_k(embeddings: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each query its ``k`` highest inner products: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id. Components are turned
    into floor(1024 * x). Rows whose id or vector is null, and vectors that are empty or hold null or non-finite
    components, take no part; vectors are compared with those of their own length. Of several rows with one query id the
    least vector asks; each row of a repeated id is a candidate. Other columns are ignored.

    Cells are cut by a sample of at most ``CELL_SAMPLE * MOST_CELLS`` vectors; every vector is placed in one. A cell's
    rows are dealt into shards of about ``SHARD_ROWS`` by a hash of the id, so equal vectors, however many, spread. A task
    holds one shard's tree and streams the queries past it. Each task that routes queries holds the cells' boxes, at most
    ``BOX_NUMBERS`` numbers, so a query's vector is sent only to shards that may hold one of its ``k`` best. Of a shard
    each query returns at most ``k`` rows.
    """
    x = F.col(vector_column).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(sound, F.lit(False)))
    placed, _ = _placed(rows)
    placed = written(placed, "top-k-cells")
    boxes = _boxes(placed)
    blocks = {c: max(1, -(-n // SHARD_ROWS)) for c, (n, _, _) in boxes.items()}
    of_cell = embeddings.sparkSession.createDataFrame(list(blocks.items()) or [(0, 1)], "cell int, blocks int")
    vectors = placed.join(F.broadcast(of_cell), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    queries = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("x", "cell", "block")).alias("q")).select("id", "q.*")
    home = written(_best(_searched(vectors, queries.withColumn("known", F.lit(None).cast("double")), k), k).select("query_id", "vec_id", "score"), "top-k-home")
    if sum(blocks.values()) > 1:
        kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("known"))
        asked = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "x", "known", "cell", "block")
        home = home.union(_searched(vectors, _routed(asked, boxes, blocks), k))
    return _best(home, k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL, over its view ``embeddings``.
ORACLE = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024e0 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
