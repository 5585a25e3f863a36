"""Exact join of documents by Jaccard similarity of their word shingles, in a metric space.

Jaccard distance d is a metric. Equal sets are one point, and points within the radius
r (0.2 for similarity 0.8) are linked.

Most sets lie at distance 1 from each other, where no pivot tells anything. They are
told apart first, by counting: a linked set of n shingles has ceil(0.8 n) of them in
another one. So a point goes on only if enough of its first shingles (in hash order),
then of all, occur in other points too. Those that go on meet in the regions of the
shingles that they share: of the first n - ceil(0.8 n) + 1 of each, rarest first (by
exact counts), a linked pair shares one.

Regions are then joined as in a metric tree, all of them at once:
- Pivots are points of the region, taken by a hash, so that overlapping regions take the
  same ones. Every point is measured against the region's pivots, exactly; those within
  r are linked to the pivot, and connected points carry one color (their component so
  far). A region of one color is done.
- The others fall into Voronoi cells by their nearest pivot. A linked pair x, y with y
  in the cell of p has d(x, p) <= d(x, nearest pivot of x) + 2 r, so x is replicated to
  all cells within that window. In a cell, points of the pivot's color can be linked to
  one of another color only if their distances to the pivot differ by at most r; those
  outside of that window go.
- Where few points are of another color than the rest, their pairs are found at once, by what the
  places of the shared shingle leave possible. Else cells are regions of the next round. A region whose windows would replicate too much
  (its points are all about equally far from its pivots) stays
  whole, without its pivots and with more of them, while these link points; else it is parted by the next shingle that two points may share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm import _shingles as S
from siltstone.llm._common import free_name, python_ready, stash, unstash
from siltstone.llm._components import colored, merged
from siltstone.llm._filters import Bitmap, bitmap, release

#: Similarity in percent and words of a shingle.
PERCENT, K = 80, 5
#: Pivots of a region of more than four times as many points in the first round, and twice as many in each later one.
PIVOTS = 8
#: A region is parted into cells if these hold at most SPREAD times its points. After the first round, up to WHOLE points
#: that are of another color than the rest of their region meet all points of other colors.
SPREAD, WHOLE = 1.5, 2048


def sets(texts: pa.Array, hasher: S.Hasher, k: int = K) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = S.shingles(*hasher.words(texts), k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(hashes[a:b])


def point(own: np.ndarray) -> int:
    """Identifier of a set: equal sets have one; as a signed 64-bit number."""
    mixed = S.mixed(own)
    total = int(mixed.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(mixed)) + len(own)
    return int(S.mixed(np.array([total & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def misses(n: int, percent: int = PERCENT) -> int:
    """Shingles of n that a linked set may lack."""
    return n * (100 - percent) // 100


def head_size(n: int, percent: int = PERCENT) -> int:
    """First shingles that are looked at: most of them are in a linked set."""
    return min(n, 2 * misses(n, percent) + 1)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Of the first head_size(n) shingles of a linked set, how many are at least among the first of another one.

    The set whose head ends at the smaller hash has misses + 1 of them in the other's head. The other one has at least
    ceil(percent n / 100) shingles if it is the smaller set.
    """
    return misses(-(-percent * n // 100), percent) + 1


def _points(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of each document (frame of id, t): (id, n, x, least, head): its shingles, its point (null without a word), and the head
    of the point where it is met first in a task."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = S.Hasher(), set()
        for batch in batches:
            for part in S.slices(batch, 1):
                ns, xs, least, heads = [], [], [], []
                for own in sets(part.column(1), hasher, k):
                    n, x, head = len(own), None, None
                    if n:
                        x = point(own)
                        if x not in seen:
                            if len(seen) < 1 << 19:  # copies that are met again later only cost rows
                                seen.add(x)
                            head = np.sort(S.mixed(own))[: head_size(n, percent)].view(np.int64)
                    ns.append(n)
                    xs.append(x)
                    least.append(least_shared(n, percent))
                    heads.append(head)
                arrays = [part.column(0), pa.array(ns, pa.int64()), pa.array(xs, pa.int64()), pa.array(least, pa.int32()), pa.array(heads, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "x", "least", "head"])

    return docs.mapInArrow(run, f"id {kind}, n long, x long, least int, head array<long>")


def _sets_of(docs: DataFrame, k: int, wanted: Bitmap) -> DataFrame:
    """(x, s): the shingles of points that are in the bitmap, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # of a bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = S.Hasher(), set()
        for batch in batches:
            for part in S.slices(batch, 1):
                xs, ss = [], []
                for own in sets(part.column(1), hasher, k):
                    if not len(own) or (x := point(own)) in seen or not shared.value.has(np.array([x], np.int64).view(np.uint64))[0]:
                        continue
                    if len(seen) < 1 << 19:
                        seen.add(x)
                    xs.append(x)
                    ss.append(np.sort(S.mixed(own)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ss, pa.list_(pa.int64()))], ["x", "s"])

    return docs.mapInArrow(run, "x long, s array<long>")


def _heads_in(points: DataFrame, wanted: Bitmap) -> DataFrame:
    """(t, x, least): the shingles of points' heads that are in the bitmap."""
    shared = points.sparkSession.sparkContext.broadcast(wanted)  # of a bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(2)
            flat = heads.flatten()
            keep = np.flatnonzero(shared.value.has(flat.to_numpy(zero_copy_only=False).view(np.uint64)))
            owner = np.repeat(np.arange(len(heads)), heads.value_lengths().to_numpy(zero_copy_only=False))[keep]
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(keep)), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))], ["t", "x", "least"])

    return points.where(F.col("head").isNotNull()).select("x", "least", "head").mapInArrow(run, "t long, x long, least int")


def _candidates(docs: DataFrame, points: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, n, s): points with enough shingles in their heads that are in the heads of others."""
    spark = docs.sparkSession
    heads = points.where(F.col("head").isNotNull()).select("x", "least", F.explode("head").alias("t"))
    shared = heads.groupBy("t").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("lo") < F.col("hi")).select("t")
    shared = stash(shared, "shared")
    release(spark)
    # Most shingles are in one head only; the bitmap keeps them from being shuffled again, and the exact join decides.
    thin = _heads_in(points, bitmap(shared, "t", shared.count()))
    counted = thin.join(shared, "t", "left_semi").distinct().groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.max("least").alias("least"))
    on = stash(counted.where(F.col("c") >= F.col("least")).select("x"), "on")
    release(spark)
    unstash(shared)
    # The filter's bits follow the counted keys; what it lets through beyond them goes with the exact join.
    found = _sets_of(docs, k, bitmap(on, "x", on.count())).join(on, "x", "left_semi").dropDuplicates(["x"])
    found = stash(found.select("x", F.size("s").alias("n"), "s"), "candidates")
    release(spark)
    unstash(on)
    return found


def _regions(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (t, x, n, i, own) of the regions of rare shared shingles (i: place in the order, own: share of the point's shingles that no other has), their sets (x, n, s), and the places of all shared shingles."""
    spark = found.sparkSession
    rows = found.select("x", "n", F.explode("s").alias("t"))
    counts = stash(rows.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1), "counts")
    rows = stash(rows.join(counts, "t"), "shared-rows")
    need = F.ceil(F.col("n") * percent / 100)
    enough = stash(rows.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where(F.col("c") >= need).select("x", "c"), "enough")
    release(spark)
    # Shingles of one point only are the rarest, and need no row; the rest follow by count, then by hash.
    order = Window.partitionBy("x").orderBy("m", "t")
    place = (F.col("n") - F.col("c") + F.row_number().over(order) - 1).cast("int")
    ranked = rows.join(enough, "x").select("t", "x", "n", place.alias("i"), (1 - F.col("c") / F.col("n")).alias("own"))
    ranked = stash(ranked, "ranked")
    release(spark)
    first = ranked.where(F.col("i") < F.col("n") - need + 1)
    open_ = first.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("t")
    regions = stash(first.join(open_, "t", "left_semi"), "regions")
    members = stash(found.join(regions.select("x").distinct(), "x", "left_semi").select("x", "n", "s"), "sets")
    for old in (counts, rows, enough):
        unstash(old)
    release(spark)
    return regions, members, ranked


def _measure(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with ``both`` (shingles in common) and ``all`` (in either)."""
    left = pairs.join(shingles.select(F.col("x").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    both = left.join(shingles.select(F.col("x").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("both"), (F.col("na") + F.col("nb") - common).alias("all"))


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of points of different colors that sizes and places leave; of both, one at least isn't of the region's main color.

    Were the region's last shingle (their ``g``-th in common, at place i) followed by nothing but common ones, the two
    would still have to share enough.
    """
    mates = rows.where(F.col("color") != F.col("main")).select(
        "t", F.col("x").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("color").alias("cb")
    )
    rest = F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("ib")) + (F.col("g") - 1)
    near = (100 + percent) * rest >= percent * (F.col("n") + F.col("nb"))
    pairs = rows.join(mates, "t").where((F.col("color") != F.col("cb")) & near)
    return pairs.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()


def _rank(x: str) -> Column:
    """A number from 0 to 1 by which a point is taken as a pivot, the same in all regions."""
    return F.shiftrightunsigned(F.xxhash64(F.col(x)), 11) / float(1 << 53)


def _links(found: DataFrame, percent: int) -> DataFrame:
    """(node, root): the least point of each connected one."""
    spark = found.sparkSession
    rows, shingles, ranked = _regions(found, percent)
    rows = rows.withColumn("g", F.lit(1))
    radius = (100 - percent) / 100 + 1e-9
    linked = 100 * F.col("both") >= percent * F.col("all")
    colors = None
    stage = 0
    while True:
        seen = colored(rows, colors)
        # Of each region: its points, its main color, and how many are of another one; all three are read off partial counts.
        hues = seen.groupBy("t", "color").agg(F.count(F.lit(1)).alias("k"))
        mixed = hues.groupBy("t").agg(F.sum("k").alias("m"), F.max(F.struct("k", "color")).alias("top"))
        mixed = mixed.where(F.col("top.k") < F.col("m")).select("t", "m", (F.col("m") - F.col("top.k")).alias("q"), F.col("top.color").alias("main"))
        region = stash(seen.join(mixed, "t"), "region")
        new = []
        # In the first round every region has a pivot: one that overlapping regions share connects most of a group. Later,
        # where few points are of another color than the rest, they are compared with all of other colors.
        small = (F.col("q") <= WHOLE) if stage else F.lit(False)
        if stage:
            pairs = stash(_small_pairs(region.where(small), percent), "pairs")
            told = stash(_measure(pairs, shingles), "told")
            new.append(told.where(linked).select("a", "b"))
            unstash(pairs)
        big = region.where(~small)
        more = bool(big.limit(1).count())
        if more:
            # All points of a region share g shingles. Two whose sizes ask for no more are linked, and both with the smallest.
            smallest = big.groupBy("t").agg(F.min(F.struct("n", "x")).alias("p")).select("t", F.col("p.x").alias("a"), F.col("p.n").alias("na"))
            enough = (F.col("x") != F.col("a")) & ((100 + percent) * F.col("g") >= percent * (F.col("n") + F.col("na")))
            new.append(stash(big.join(smallest, "t").where(enough).select("a", F.col("x").alias("b")).distinct(), "enough"))
            # The point with the fewest shingles of its own is nearest to what the group has in common.
            first = F.struct("own", _rank("x").alias("rank"))
            least = big.groupBy("t").agg(F.min(first).alias("least"))
            taken = (first == F.col("least")) | ((F.col("m") > 4 * PIVOTS) & (_rank("x") < F.lit(PIVOTS << stage) / F.col("m")))
            marked = stash(big.join(least, "t").withColumn("pivot", taken).drop("least"), "marked")
            pivots = marked.where("pivot").select("t", F.col("x").alias("a"), F.col("n").alias("na"), F.col("color").alias("ca"))
            asked = marked.join(pivots, "t").where(F.col("x") != F.col("a"))
            # Pivots among themselves are measured once.
            asked = asked.select(F.when(F.col("pivot"), F.least("a", "x")).otherwise(F.col("a")).alias("a"), F.when(F.col("pivot"), F.greatest("a", "x")).otherwise(F.col("x")).alias("b"))
            asked = stash(asked.distinct(), "asked")
            told = stash(_measure(asked, shingles), "told")
            new.append(told.where(linked).select("a", "b"))
        links = new[0] if new else spark.createDataFrame([], "a long, b long")
        for x in new[1:]:
            links = links.unionByName(x)
        colors = merged(colors, links)
        unstash(region)
        release(spark)
        if not more:
            for x in (shingles, ranked):
                unstash(x)
            return colors
        rows = stash(_next(marked, pivots, told, colors, ranked, percent, radius), "rows")
        for x in (marked, asked, told):
            unstash(x)
        release(spark)
        stage += 1


def _next(marked: DataFrame, pivots: DataFrame, told: DataFrame, colors: DataFrame, ranked: DataFrame, percent: int, radius: float) -> DataFrame:
    """Regions (t, x, n, i, own, g) of the next round: cells of the Voronoi partition, or what is left of regions that stay whole or are parted by a shingle."""
    seen = stash(colored(marked.drop("color"), colors), "seen")
    hues = seen.groupBy("t", "color").agg(F.count(F.lit(1)).alias("k"))
    open_ = hues.groupBy("t").agg(F.sum("k").alias("now"), F.max("k").alias("top")).where(F.col("top") < F.col("now"))
    open_ = open_.select("t", (F.col("now") - F.col("top") > WHOLE).alias("many"))
    seen = seen.join(open_, "t")
    shape = ["t", "x", "n", "i", "own", "g"]
    few = seen.where(~F.col("many")).select(*shape)
    rest = seen.where(F.col("many") & ~F.col("pivot")).drop("many")
    hubs = colored(pivots.select("t", F.col("a").alias("x")), colors).select("t", F.col("x").alias("a"), F.col("color").alias("ca"))
    far = told.select("a", F.col("b").alias("x"), (1 - F.col("both") / F.col("all")).alias("d"))
    cells = rest.join(hubs, "t").join(far, ["a", "x"])
    nearest = cells.groupBy("t", "x").agg(F.min("d").alias("near"))
    cells = stash(cells.join(nearest, ["t", "x"]).where(F.col("d") <= F.col("near") + 2 * radius), "cells")
    # Within a cell, points of the pivot's color matter only near one of another color.
    other = F.when(F.col("color") != F.col("ca"), F.col("d"))
    bounds = cells.groupBy("t", "a").agg(F.min(other).alias("low"), F.max(other).alias("high")).where(F.col("low").isNotNull())
    window = (F.col("color") != F.col("ca")) | F.col("d").between(F.col("low") - radius, F.col("high") + radius)
    kept = stash(cells.join(bounds, ["t", "a"]).where(window).select(*shape, "a", "m", "d"), "kept")
    spread = kept.groupBy("t").agg(F.count(F.lit(1)).alias("held"), F.max("m").alias("m"), (F.avg((F.col("d") <= radius).cast("int")) >= 1 / PIVOTS).alias("dense"))
    fate = F.when(F.col("held") <= SPREAD * F.col("m"), "cells").when(F.col("dense"), "whole").otherwise("parted")
    kept = kept.join(spread.select("t", fate.alias("fate")), "t")
    split = kept.where("fate = 'cells'").withColumn("t", F.xxhash64("t", "a")).select(*shape)
    whole = kept.where("fate = 'whole'").select(*shape).distinct()
    # The next shingle that two points share stands among the first that the misses so far leave; its place is theirs alone.
    parted = kept.where("fate = 'parted'").select(*shape).distinct()
    last = F.least(F.floor(F.col("n") * (100 - percent) / 100) + F.col("g"), F.col("n") - 1)
    later = ranked.select("x", F.col("i").alias("j"), F.col("t").alias("u"))
    ahead = parted.join(later, "x").where((F.col("j") > F.col("i")) & (F.col("j") <= last))
    ahead = ahead.select(F.xxhash64("t", "u").alias("t"), "x", "n", F.col("j").alias("i"), "own", (F.col("g") + 1).alias("g"))
    return few.unionByName(split).unionByName(whole).unionByName(ahead)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: the size of its shingle set and the smallest id it is connected with.

    Words are runs without white space, A-Z as a-z. A text with fewer than k words is one shingle, if it has a word; null
    texts and those without words have an empty set and are connected with nothing (component: the own id). Equal rows
    each give a row. Null ids are treated as larger than all others; a component of null ids alone has a null id. Other
    columns are left out; an empty table gives no row. Shingles, and sets, are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    python_ready(spark)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    whole = stash(_points(base, k, percent), "points")
    found = _candidates(base, whole, k, percent)
    points = stash(whole.select("id", "n", "x"), "narrow-points")
    unstash(whole)  # the heads are no longer needed
    roots = _links(found, percent).select(F.col("node").alias("x"), "root")
    unstash(found)
    release(spark)
    grouped = points.select("id", "n", "x").join(roots, "x", "left").select("id", "n", F.coalesce("root", "x").alias("g"))
    least = grouped.where(F.col("g").isNotNull()).groupBy("g").agg(F.min("id").alias("least"))
    return grouped.join(least, "g", "left").select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = K) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns; of several rows with that id, all."""
    name = free_name(docs.columns, "kept_id")
    kept = join(docs, doc_id, text, percent, k).where(F.col("component_id").eqNullSafe(F.col(doc_id))).select(F.col(doc_id).alias(name)).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept[name]), "left_semi")
