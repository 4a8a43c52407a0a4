"""Near-duplicate documents by SetSketch registers: bands find candidates, the joint likelihood sifts them, full sets
confirm links, and links make components.

A register holds the exponent of the least of one exponential variable per shingle, in powers of a base and truncated to
16 bits; registers of a union are the larger ones of two sets. All variables of a shingle come from one Poisson process
whose points fall on registers at random, in rising order, so a document draws only the points that can still be least.
Two sets agree in a register about as often as their Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

REGISTERS = 192
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair at the threshold misses all bands with at most this probability.
MISS = 1e-6
#: A candidate goes on to the full sets unless the likelihood of the threshold is below the best one's by this exponent.
DOUBT = 14.0
#: Groups over which the pairs of one hub are dealt.
HUB_PARTS = 64
#: Members of a bucket's minor components that meet in one block.
BLOCK = 256
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIER, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
SEGMENT = 1 << 17
#: Bits of the maps of ids that thin out what a join shuffles.
BITS = 1 << 25
#: Variables that a step of the sketches draws at once.
DRAWS = 1 << 18
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finishing steps."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, letters A to Z lowered, and where the words start.

    A word's hash is a polynomial over its bytes: the difference of two running sums, divided by the power at its start.
    """
    octets = np.frombuffer(data.translate(LOWER), dtype=np.uint8)
    inside = np.concatenate(([False], ~IS_SEPARATOR[octets], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):  # a segment of whole words at a time
        last = max(int(np.searchsorted(ends, starts[first] + SEGMENT, side="right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        size = max(SEGMENT, 1 << (high - low).bit_length())
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((octets[low:high].astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, size)[: high - low], dtype=np.uint64)))
        a, b = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = (sums[b] - sums[a]) * powers(INVERSE, size)[a] + (b - a).astype(np.uint64) * GOLDEN
        first = last
    return mix(hashes), starts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: windows of ``width`` words, or all words where there are fewer."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < 4 * SEGMENT):
            size += len(texts[to]) + 1
            to += 1
        part = texts[at:to]
        hashes, starts = word_hashes(b"\n".join(part))
        borders = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        rolled = hashes.copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                rolled[: len(hashes) - k] = mix(rolled[: len(hashes) - k] * GOLDEN + hashes[k:]) if k < len(hashes) else rolled[:0]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if b - a >= width:
                    out.append(np.unique(rolled[a : b - width + 1]))
                elif b > a:
                    whole = np.uint64(b - a)
                    for h in hashes[a:b]:
                        whole = mix(np.asarray([whole * GOLDEN + h], dtype=np.uint64))[0]
                    out.append(np.asarray([whole], dtype=np.uint64))
                else:
                    out.append(np.empty(0, dtype=np.uint64))
        at = to
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of the sets, a row each; 0 throughout for an empty set."""
    minima = np.full((len(sets), REGISTERS), np.inf)
    todo = np.flatnonzero([len(s) > 0 for s in sets])
    reach = np.log(REGISTERS) + 8.0
    while len(todo):
        flat, limits = minima.reshape(-1), reach / np.asarray([len(sets[i]) for i in todo])
        seeds = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
        base, limit = todo[owner] * REGISTERS, limits[owner]
        time, drawn, several = np.zeros(len(seeds)), 0, 4
        with np.errstate(over="ignore"):
            while len(seeds):
                several = max(1, min(several, DRAWS // len(seeds)))
                z = mix(seeds[:, None] + np.arange(drawn + 1, drawn + several + 1, dtype=np.uint64) * GOLDEN)
                gaps = -np.log(((z >> np.uint64(24)).astype(np.float64) + 1.0) * 2.0**-40) / REGISTERS
                times = time[:, None] + np.cumsum(gaps, axis=1)
                hit = times <= limit[:, None]
                where = base[:, None] + (((z & np.uint64(0xFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(24)).astype(np.int64)
                np.minimum.at(flat, where[hit], times[hit])
                more = hit[:, -1]
                seeds, base, limit, time = seeds[more], base[more], limit[more], times[more, -1]
                drawn, several = drawn + several, several * 2
        todo = todo[~np.isfinite(minima[todo]).all(axis=1)]
        reach *= 2
    with np.errstate(divide="ignore", invalid="ignore"):
        exponent = np.floor(1.0 - np.log(minima / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(exponent, neginf=0, posinf=TOP), 0, TOP).astype("<u2")


def band_rows(similarity: float) -> int:
    """Registers to a band: the most with which a pair at the threshold is missed with a probability of at most MISS."""
    fits = [r for r in range(1, 17) if (1.0 - similarity**r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    bands = REGISTERS // rows
    cut = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, cut.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix(key * GOLDEN + cut[:, :, i])
    return key.view(np.int64)


def brief(registers: np.ndarray) -> np.ndarray:
    """The last four bits of each register, two registers a byte: what agrees in whole agrees in these."""
    low = (registers & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def least_equal(similarity: float) -> float:
    """How many registers of a pair at the similarity agree, but for a chance that ``DOUBT`` leaves out."""
    return REGISTERS * similarity - np.sqrt(2.0 * DOUBT * REGISTERS * similarity * (1.0 - similarity)) - 4.0


def plausible(left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs may reach the similarity, by the joint likelihood of their registers given the sizes of their sets."""
    # registers that agree are about as many as the similarity says; far too few settle most pairs
    equal = (left == right).sum(axis=1)
    if not (likely := equal >= least_equal(similarity)).all():
        out = np.zeros(len(left), dtype=bool)
        if likely.any():
            out[likely] = plausible(left[likely], right[likely], left_size[likely], right_size[likely], similarity)
        return out
    above = (left > right).sum(axis=1)
    below = REGISTERS - above - equal
    u = left_size / (left_size + right_size)
    v = 1.0 - u
    top = np.minimum(u / v, v / u)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = share(u - v * j), share(v - u * j)
        log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-12)), 0.0)
        return log(above, p) + log(below, q) + log(equal, 1.0 - p - q)

    low, high = np.zeros(len(u)), top.copy()  # the likelihood has one peak
    for _ in range(40):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        rising = likelihood(a) < likelihood(b)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    best = (low + high) / 2
    least = np.minimum(similarity, top)
    return (best >= least) | (likelihood(best) - likelihood(least) <= DOUBT)


def enough(same: int, left: int, right: int, percent: int) -> bool:
    return 100 * same >= percent * (int(left) + int(right) - same)


def linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, exactly."""
    if not len(left) or not len(right) or 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    return enough(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), percent)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids of links (a, b) that have a smaller one: the smallest id that links lead to.

    Alternates large and small stars: each id's larger neighbours, then its smaller ones, are hung on the smallest of
    its neighbourhood. An id's neighbourhood is only ever reduced to its minimum, with partial sums before the shuffle.
    """
    edges = written(links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        large = written(large, "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").selectExpr("explode(array(struct(a AS a, m AS b), struct(b AS a, m AS b))) AS e").select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct(), "small-star")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            sets = shingle_sets([d or b"" for d in batch["data"].to_pylist()], width)
            registers = sketch(sets)
            yield {
                "id": batch["id"],
                "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "registers": [r.tobytes() for r in registers],
                "brief": [r.tobytes() for r in brief(registers)],
            }

    return map_rows(docs.selectExpr("id", "data"), rows, "id bigint, n bigint, digest binary, registers binary, brief binary", slice_rows=256)


def _banded(classes: DataFrame, rows_per_band: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            registers = np.frombuffer(b"".join(batch["registers"].to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            keys = band_keys(registers, rows_per_band)
            yield {"key": keys.reshape(-1), "id": np.repeat(batch["id"].to_numpy(zero_copy_only=False), keys.shape[1])}

    return map_rows(classes.select("id", "registers"), rows, "key bigint, id bigint", slice_rows=2048)


def marked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with ``map_met``: true where their ``key`` may be among ``ids`` (id), false or null where it is not.

    Ids set bits by hash in maps of ``BITS`` together, a fixed size, which go to all tasks. Where ids are so many that most
    bits are set, nearly all rows are met and a join does what it would have done.
    """
    spot = lambda k: F.pmod(F.xxhash64(F.col(k).cast("bigint")), F.lit(BITS)) + 1
    maps = ids.select(spot("id").alias("spot")).groupBy(F.expr("bitmap_bucket_number(spot)").alias("map_no")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("map_bits"))
    met = rows.withColumn("map_spot", spot(key)).withColumn("map_no", F.expr("bitmap_bucket_number(map_spot)")).join(F.broadcast(maps), "map_no", "left")
    bit = F.expr("getbit(cast(conv(hex(substring(map_bits, cast(bitmap_bit_position(map_spot) div 8 as int) + 1, 1)), 16, 10) as bigint), cast(bitmap_bit_position(map_spot) % 8 as int))")
    return met.select(*rows.columns, (bit == 1).alias("map_met"))


def thinned(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ``ids`` (id), and few others: a filter ahead of a join that shuffles them."""
    return marked(rows, ids).where("map_met").select(rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose ``key`` is not among ``ids`` (key), as often as they stand; rows without key stay.

    Only rows whose key may be among them are shuffled for the join that settles it; the others stay where they are read.
    """
    told = marked(rows, ids.select(F.col(key).alias("id")), key)
    doubtful = told.where("map_met").select(rows.columns).join(ids.select(key), key, "left_anti")
    return told.where("NOT coalesce(map_met, false)").select(rows.columns).unionByName(doubtful.select(rows.columns))


def _roughly(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of which enough registers may agree, by four bits of each."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("brief").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("brief").alias("rb"))
    both = pairs.join(right, "b").join(left, "a").where((F.least("na", "nb") >= F.lit(similarity - 1e-9) * F.greatest("na", "nb")))

    def rows(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch[k].to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS // 2) for k in ("ra", "rb"))
            apart = ra ^ rb
            keep = ((apart & 0xF0) == 0).sum(axis=1) + ((apart & 0x0F) == 0).sum(axis=1) >= least_equal(similarity)
            yield {k: batch[k].to_numpy(zero_copy_only=False)[keep] for k in ("a", "b")}

    return map_rows(both.select("a", "b", "ra", "rb"), rows, "a bigint, b bigint", slice_rows=4096)


def _sifted(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that their registers leave plausible; whole registers travel only for pairs that four bits of each leave."""
    pairs = written(_roughly(pairs, classes, similarity), "rough-pairs")
    classes = thinned(classes, pairs.selectExpr("explode(array(a, b)) AS id"))
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    both = pairs.join(right, "b").join(left, "a").where((F.least("na", "nb") >= F.lit(similarity - 1e-9) * F.greatest("na", "nb")))

    def rows(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch[k].to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for k in ("ra", "rb"))
            na, nb = (batch[k].to_numpy(zero_copy_only=False).astype(np.float64) for k in ("na", "nb"))
            keep = plausible(ra, rb, na, nb, similarity)
            yield {k: batch[k].to_numpy(zero_copy_only=False)[keep] for k in ("a", "b")}

    return map_rows(both.select("a", "b", "na", "nb", "ra", "rb"), rows, "a bigint, b bigint", slice_rows=4096)


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a hub, b) whose full sets are similar enough.

    A hub's pairs are dealt over ``HUB_PARTS`` groups; a group holds the hub's text once and streams the others past it,
    so neither a task nor the copies of a text grow with the hub.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)).cast("int").alias("part"))
    needed = classes.select("id", "digest").join(dealt.selectExpr("explode(array(a, b)) AS id").distinct(), "id", "left_semi")
    held = thinned(texts, dealt.selectExpr("explode(array(a, b)) AS id")).join(needed, "id").select("id", "data", "digest")
    hubs = dealt.select("a", "part").distinct().join(held.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "data", "digest")
    members = dealt.join(held.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "data", "digest")
    both = hubs.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def rows(batches):
        hub, own = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for x, part, y, data, digest in zip(*(batch[k].to_pylist() for k in ("a", "part", "b", "data", "digest")), strict=True):
                if hub != (x, part):
                    hub, own = (x, part), own[:0]
                shingles = shingle_sets([data], width)[0]
                # an id may stand in several rows with different texts: only the one of its class counts
                if hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() != digest:
                    continue
                if y is None:
                    own = shingles
                elif linked(own, shingles, percent):
                    a.append(x)
                    b.append(y)
            yield {"a": a, "b": b}

    return map_rows(both, rows, "a bigint, b bigint", slice_rows=256)


def _is_text(data: bytes, digest: bytes, width: int) -> bool:
    """Whether the text is the one of the class: an id may stand in several rows with different texts."""
    return hashlib.blake2b(shingle_sets([data], width)[0].tobytes(), digest_size=16).digest() == digest


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among bucket members (key, id, component).

    The bucket's largest component may be huge: its members meet only those of the others. Those are cut into blocks,
    each pair of which meets once; the largest component is cut into slices, each of which meets each block. A group of
    blocks or of a block and a slice is bounded. Pairs are compared where they meet, only in the first band that they
    share: first by registers alone, then, of the members that keep a partner, by full sets. Only links leave the task,
    each of which joins two components: no more rows than members.
    """
    similarity, rows_per_band = percent / 100, band_rows(percent / 100)
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    major = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"))
    part = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    major = major.select("key", F.col("top.component").alias("major"), part(F.col("total") - F.col("top.n"), BLOCK).alias("blocks"), part(F.col("top.n"), 8 * BLOCK).alias("slices"))
    placed = members.join(major, "key").withColumn("minor", F.col("component") != F.col("major"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("bigint")).cast("int")
    placed = placed.withColumn("block", at("blocks")).withColumn("slice", at("slices"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a group is (key, x, y): blocks x <= y of minor members, or block x and slice -1 - y of the major component
    pairs_of_blocks = F.transform(upto("blocks"), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    with_slices = F.transform(upto("slices"), lambda o: F.struct(F.col("block").alias("x"), (-1 - o).alias("y")))
    from_slice = F.transform(upto("blocks"), lambda o: F.struct(o.alias("x"), (-1 - F.col("slice")).alias("y")))
    groups = placed.select("key", "id", "component", "minor", "block", F.explode(F.when(F.col("minor"), F.concat(pairs_of_blocks, with_slices)).otherwise(from_slice)).alias("g"))
    groups = groups.select("key", "g.x", "g.y", "id", "component", "minor", "block")
    columns = ("key", "x", "y", "id", "component", "minor", "block", "n", "digest", "registers")

    def grouped(batches, names: tuple[str, ...]):
        """Rows of one group at a time: at most two blocks, or a block and a slice."""
        group: list = []
        for batch in batches:
            for row in zip(*(batch[k].to_pylist() for k in names), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def partners(group: list):
        """Of each member of the first block, in turn: its plausible partners on the other side, by place in the group."""
        x, y = group[0][1:3]
        comps, sizes, blocks = (np.asarray([r[k] for r in group], dtype=np.int64) for k in (4, 7, 6))
        minor = np.asarray([r[5] for r in group], dtype=bool)
        registers = np.frombuffer(b"".join(r[9] for r in group), dtype="<u2").reshape(-1, REGISTERS)
        keys = band_keys(registers, rows_per_band)
        one = np.flatnonzero(minor & (blocks == x))
        two = np.flatnonzero(~minor if y < 0 else minor & (blocks == y))
        for i in one:
            others = two[(comps[two] != comps[i]) & ((y != x) | (two > i))]
            others = others[np.minimum(sizes[i], sizes[others]) >= (similarity - 1e-9) * np.maximum(sizes[i], sizes[others])]
            if not len(others):
                continue
            same = keys[others] == keys[i]
            # a pair meets in the first band that it shares only
            others = others[keys[i][same.argmax(axis=1)] == group[i][0]]
            if len(others):
                fits = plausible(registers[np.full(len(others), i)], registers[others], np.full(len(others), float(sizes[i])), sizes[others].astype(float), similarity)
                yield int(i), others[fits]

    def sifted(batches):
        for group in grouped(batches, columns):
            found: set[int] = set()
            for i, others in partners(group):
                if len(others):
                    found |= {i, *others.tolist()}
            if found:
                yield dict(zip(columns, zip(*(group[i] for i in sorted(found)), strict=True), strict=True))

    met = groups.join(classes.join(groups.select("id").distinct(), "id", "left_semi"), "id").select(*columns)
    met = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    types = "key bigint, x int, y int, id bigint, component bigint, minor boolean, block int, n bigint, digest binary, registers binary"
    # texts go only to groups in which their registers leave a link possible
    met = written(map_rows(met, sifted, types, slice_rows=2048), "across-sifted")
    # no semi-join here: it would be moved ahead of the maps
    with_texts = thinned(texts, met.select("id")).join(met, "id").select(*columns, "data")
    with_texts = with_texts.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")

    def confirmed(batches):
        for group in grouped(batches, (*columns, "data")):
            group = list({(r[3], r[6], r[5]): r for r in group if _is_text(r[10], r[8], width)}.values())
            if not group:
                continue
            sets: dict[int, np.ndarray] = {}

            def set_of(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_sets([group[i][10]], width)[0]  # noqa: B023
                return sets[i]

            comps = np.asarray([r[4] for r in group], dtype=np.int64)
            a, b = [], []
            for i, others in partners(group):
                for o in others.tolist():
                    # members that earlier links of this group have joined need no more of them
                    if comps[o] != comps[i] and linked(set_of(i), set_of(o), percent):
                        a.append(min(group[i][3], group[o][3]))
                        b.append(max(group[i][3], group[o][3]))
                        comps[comps == comps[o]] = comps[i]
            yield {"a": a, "b": b}

    return map_rows(with_texts, confirmed, "a bigint, b bigint", slice_rows=512)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (the smallest id that links lead to) and kept (id = component_id).

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of ``width``-word shingles. Texts
    without words, and null texts, have an empty set, link with nothing and are kept. Rows keep their multiplicity; an
    id with several texts is linked by one of them, and all its rows follow. Rows with a null id take part only as copies
    of others: their component is that of the documents with their set, else null, and they are not kept. Other columns
    are ignored, whatever their names.

    Documents with equal sets form a class, from then on one row with the smallest id. The smallest id in a bucket of a
    band is its hub. Each member is compared with the smallest hub it meets, then with the smallest of another component
    (stars, never all pairs); confirmed links give components. Then members of different components of one bucket are
    compared, in blocks, so no link among candidates is lost, and members of one component, however many, are not
    compared with one another.
    """
    similarity = percent / 100
    rows_per_band = band_rows(similarity)
    slim = docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"CAST(`{text_column}` AS BINARY) AS data")
    sketches = written(_sketched(slim, width), "sketches")
    sets = sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("class"), F.max("n").alias("n"))
    nodes = sets.where("class IS NOT NULL").groupBy(F.col("class").alias("id")).agg(F.min(F.struct("digest", "n")).alias("s")).select("id", "s.digest", "s.n")
    classes = nodes.join(sketches.select("id", "digest", "registers", "brief"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    classes = written(classes, "classes")

    banded = _banded(classes, rows_per_band)
    buckets = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    member = written(banded.join(buckets, "key"), "members")
    texts = slim.where("id IS NOT NULL AND data IS NOT NULL")

    def stars_of(rows: DataFrame) -> DataFrame:
        """Of each member the smallest hub of its buckets: one pair a member, however many buckets and hubs."""
        pairs = rows.groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
        return written(_sifted(pairs, classes, similarity), "stars")

    tried = stars_of(member.where("id <> hub"))
    links = written(_confirmed(tried, classes, texts, width, percent), "star-links")
    joined = components(links)
    # once more with hubs of other components, since the smallest hub may have been a chance neighbour
    of = lambda k: joined.select(F.col("id").alias(k), F.col("component").alias(f"{k}_component"))
    apart = member.where("id <> hub").join(of("id"), "id", "left").join(of("hub"), "hub", "left")
    apart = apart.where("coalesce(id_component, id) <> coalesce(hub_component, hub)").join(tried.select(F.col("a").alias("hub"), F.col("b").alias("id")), ["hub", "id"], "left_anti")
    second = stars_of(apart)
    if not second.isEmpty():
        links = written(links.union(_confirmed(second, classes, texts, width, percent)), "star-links")
        joined = components(links)

    labelled = member.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    across = written(_across(labelled.join(several, "key", "left_semi"), classes, texts, width, percent), "across")
    if not across.isEmpty():
        joined = components(links.union(across))

    found = sets.join(joined, sets["class"] == joined["id"], "left").select("digest", F.coalesce("component", "class").alias("component"))
    out = sketches.select("id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def near_duplicates_sql(width: int, percent: int) -> str:
    """The rows of ``near_duplicates`` over ``documents`` whose ids are neither null nor repeated, as DuckDB SQL."""
    shingle = " || ' ' || ".join(f"ws[i + {n}]" for n in range(width))
    return rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
each AS (SELECT doc_id, unnest(CASE WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: {shingle}) END) AS shingle FROM words WHERE len(ws) > 0),
sets AS (SELECT DISTINCT doc_id, shingle FROM each),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reached AS (SELECT doc_id AS id, doc_id AS component FROM documents UNION SELECT links.b, component FROM reached JOIN links ON reached.id = links.a),
least AS (SELECT id, min(component) AS component FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, component = d.doc_id AS kept FROM least LEFT JOIN sizes ON sizes.doc_id = least.id JOIN documents d ON d.doc_id = least.id"""
