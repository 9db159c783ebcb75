"""Spherical k-means of groups of any size, all groups at once, with the labels of ``skills.spherical_kmeans``.

The points of a group lie in blocks of CHUNK; a block meets the group's centres by key and is one
matrix product.  The farthest-first start keeps each point's largest cosine to the centres so far
as a column.  A round takes the points that lie farthest out in each block, CANDIDATES of a group,
and lets one task choose among them for as long as its choice is surely the group's: cosines only
grow, so no other point can fall below the last candidate of its block.  Steps of the iteration are
products, grouped sums and a comparison of labels.  A centre is made anew only if its members
changed; a point whose own centre stayed meets the new centres only.  A group whose labels stay is
done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .search import _matrix

#: Points of a block, centres of a block, points among which a round chooses, and centres of a product.
CHUNK, CENTRES, CANDIDATES, PRODUCT = 4096, 16384, 8192, 1024
#: Clusters whose sums one task adds up.
BAND = 512
#: Decimals at which cosines are compared, so that products in another order choose alike.
DECIMALS = 12

GROUP = ["bucket", "part"]
_POINTS = "bucket string, part string, block int, point_id long, v array<double>, closest double, most int, far boolean, edge boolean"


def _take(table: pa.Table, names: list[str], n: int) -> list[pa.Array]:
    return [pa.repeat(table.column(name)[0], n) if table.num_rows else table.schema.field(name).type and pa.array([], table.schema.field(name).type) for name in names]


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel(), pa.float64())).cast(pa.list_(pa.float64()))


def _drawn_near(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with ``closest`` raised to the largest cosine to new centres (bucket, part, c), the ``most`` farthest out of their block marked ``far`` and the last of these ``edge`` if others lie behind it."""

    def near(own: pa.Table, new: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own
        closest = own.column("closest").to_numpy().copy()
        if new.num_rows:
            v, c = (_matrix(t.column(name).combine_chunks()) for t, name in ((own, "v"), (new, "c")))
            for k in range(0, len(c), PRODUCT):
                closest = np.maximum(closest, np.round(v @ c[k : k + PRODUCT].T, DECIMALS).max(axis=1))
        order, most = np.lexsort((own.column("point_id").to_numpy(), closest)), own.column("most")[0].as_py()
        far, edge = np.zeros((2, len(order)), bool)
        far[order[:most]] = True
        edge[order[most - 1 : most]] = len(order) > most
        for name, x in (("closest", closest), ("far", far), ("edge", edge)):
            own = own.set_column(own.schema.get_field_index(name), name, pa.array(x))
        return own

    blocks = points.groupBy(*GROUP).agg((F.max("block") + 1).alias("blocks"))
    spread = centres.join(blocks, GROUP).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*GROUP, "block", "c")
    keys = [*GROUP, "block"]
    return cut(points.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(near, _POINTS))


def _choose(sizes_k: DataFrame, points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The centres that a round adds: bucket, part, cluster, c."""
    have = chosen.groupBy(*GROUP).agg(F.count("*").alias("have"))
    open_ = sizes_k.join(have, GROUP).where("have < k")
    held = points.where("far").select(*GROUP, "point_id", "v", "closest", "edge").join(open_.select(*GROUP, "k", "have"), GROUP)

    def pick(own: pa.Table) -> pa.Table:
        own = own.sort_by([("point_id", "ascending")])
        v, now, ids = _matrix(own.column("v").combine_chunks()), own.column("closest").to_numpy().copy(), own.column("point_id").to_numpy()
        k, have = (own.column(x)[0].as_py() for x in ("k", "have"))
        edge = np.flatnonzero(own.column("edge").to_numpy())
        last = min(zip(now[edge].tolist(), ids[edge].tolist(), strict=True), default=(np.inf, 0))  # all other points lie behind it
        rows: list[int] = []
        while have + len(rows) < k:
            at = int(np.argmin(now))
            if rows and (now[at], ids[at]) > last:
                break
            rows.append(at)
            now = np.maximum(now, np.round(v @ v[at], DECIMALS))
        return pa.table([*_take(own, GROUP, len(rows)), pa.array(np.arange(have, have + len(rows)), pa.int32()), _lists(v[rows])], names=[*GROUP, "cluster", "c"])

    return cut(held.groupBy(*GROUP).applyInArrow(pick, "bucket string, part string, cluster int, c array<double>"))


def _first_centres(sizes_k: DataFrame, points: DataFrame) -> DataFrame:
    """Farthest-first centres of each group, from its point of least id on."""
    start = points.groupBy(*GROUP).agg(F.min_by("v", "point_id").alias("c"))
    chosen = new = cut(start.select(*GROUP, F.lit(0).alias("cluster"), "c"))
    while True:
        points = _drawn_near(points, new)
        new = _choose(sizes_k, points, chosen)
        if new.isEmpty():
            return chosen
        chosen = cut(chosen.unionByName(new))


def _blocked(points: DataFrame) -> DataFrame:
    """points with block: of CHUNK points of their group about."""
    counts = points.groupBy(*GROUP).agg(F.ceil(F.count("*") / CHUNK).alias("blocks"))
    return points.join(counts, GROUP).withColumn("block", F.pmod(F.xxhash64("point_id"), F.col("blocks")).cast("int"))


def _labels(points: DataFrame, centres: DataFrame) -> DataFrame:
    """bucket, part, point_id, cluster of the largest cosine, the smaller cluster of equals, and that cosine s; points: bucket, part, block, blocks, point_id, v."""

    def label(own: pa.Table, held: pa.Table) -> pa.Table:
        n = own.num_rows if held.num_rows else 0
        own = own.slice(0, n)
        cluster, score = np.zeros(n, np.int32), np.full(n, -np.inf)
        if n:
            held = held.sort_by([("cluster", "ascending")])
            v, c, names = _matrix(own.column("v").combine_chunks()), _matrix(held.column("c").combine_chunks()), held.column("cluster").to_numpy()
            for k in range(0, len(c), PRODUCT):
                s = np.round(v @ c[k : k + PRODUCT].T, DECIMALS)
                best = np.argmax(s, axis=1)
                s = s[np.arange(n), best]
                cluster, score = np.where(s > score, names[k + best], cluster), np.maximum(s, score)
        return own.select([*GROUP, "point_id"]).append_column("cluster", pa.array(cluster, pa.int32())).append_column("s", pa.array(score))

    blocks = points.groupBy(*GROUP).agg(F.max("blocks").alias("blocks"))
    many = centres.groupBy(*GROUP).agg((F.floor(F.max("cluster") / CENTRES) + 1).cast("int").alias("bands"))
    spread = centres.join(blocks, GROUP).withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).select(*GROUP, "block", F.floor(F.col("cluster") / CENTRES).cast("int").alias("band"), "cluster", "c")
    own = points.join(many, GROUP).withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1))).select(*GROUP, "block", "band", "point_id", "v")
    keys = [*GROUP, "block", "band"]
    every = own.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(label, "bucket string, part string, point_id long, cluster int, s double")
    return _best(every)


def _best(labels: DataFrame) -> DataFrame:
    """Each point's largest cosine, the smaller cluster of equals."""
    top = F.max(F.struct("s", -F.col("cluster"), "cluster")).alias("t")
    return labels.groupBy(*GROUP, "point_id").agg(top).select(*GROUP, "point_id", "t.cluster", "t.s")


def _moved(points: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """bucket, part, cluster, c of the given centres: the normalised sums of the members; an empty cluster keeps its own.

    points: bucket, part, block, point_id, v.  Sums of a block's members meet by bands of clusters.
    """

    def sums(own: pa.Table) -> pa.Table:
        own = own.sort_by([("point_id", "ascending")]) if "point_id" in own.column_names else own
        v, at = _matrix(own.column("v").combine_chunks()), own.column("cluster").to_numpy()
        names, place = np.unique(at, return_inverse=True)
        total = np.zeros((len(names), v.shape[1]))
        np.add.at(total, place, v)
        return pa.table([*_take(own, GROUP, len(names)), pa.array(names, pa.int32()), _lists(total)], names=[*GROUP, "cluster", "v"])

    own, summed = [*GROUP, "cluster"], "bucket string, part string, cluster int, v array<double>"
    told = labels.join(centres.select(*own), own, "left_semi").select(*own, "point_id")
    members = points.join(told, [*GROUP, "point_id"]).select(*GROUP, "block", "point_id", "cluster", "v")
    parts = members.groupBy(*GROUP, "block").applyInArrow(sums, summed)
    whole = parts.groupBy(*GROUP, F.floor(F.col("cluster") / BAND)).applyInArrow(sums, summed)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    means = whole.select(*own, F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("mean"))
    return centres.join(means, own, "left").select(*own, F.coalesce("mean", "c").alias("c"))


def kmeans(points: DataFrame, target: int, iterations: int) -> DataFrame:
    """bucket, part, point_id, cluster: spherical k-means with ceil(n / target) clusters for each (bucket, part) of points.

    points: bucket, part, point_id (unique in its group), v (of length one).  The start is the
    point of least id; a group of identical points gets one label.
    """
    sizes = cut(points.groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / target)))
    points = cut(_blocked(points).select(*GROUP, "block", "blocks", "point_id", "v"))
    no = F.lit(False)
    start = points.select(*GROUP, "block", "point_id", "v", F.lit(-2.0).alias("closest"), F.ceil(CANDIDATES / F.col("blocks")).cast("int").alias("most"), no.alias("far"), no.alias("edge"))
    centres = _first_centres(sizes, start)
    labels, touched, own = cut(_labels(points, centres)), None, [*GROUP, "cluster"]
    done = None
    for _ in range(1, iterations):
        new = centres if touched is None else centres.join(touched, own, "left_semi")
        new = cut(_moved(points, labels, new))
        kept = None if touched is None else centres.join(touched, own, "left_anti")
        centres = new if kept is None else cut(kept.unionByName(new))
        if touched is None:
            fresh = cut(_labels(points, centres))
        else:
            loose = points.drop("block", "blocks").join(labels.join(touched, own, "left_semi").select(*GROUP, "point_id"), [*GROUP, "point_id"], "left_semi")
            still = labels.join(touched, own, "left_anti")
            bound = points.join(still.select(*GROUP, "point_id"), [*GROUP, "point_id"], "left_semi")
            fresh = cut(_labels(_blocked(cut(loose)), centres).unionByName(_best(_labels(bound, new).unionByName(still))))
        was = labels.select(*GROUP, "point_id", F.col("cluster").alias("was"))
        changed = fresh.join(was, [*GROUP, "point_id"]).where("cluster <> was")
        touched = cut(changed.select(*GROUP, F.explode(F.array("cluster", "was")).alias("cluster")).distinct())
        active = touched.select(*GROUP).distinct()
        ready = fresh.join(active, GROUP, "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if touched.isEmpty():
            break
        labels, centres = cut(fresh.join(active, GROUP, "left_semi")), cut(centres.join(active, GROUP, "left_semi"))
    else:
        done = labels if done is None else done.unionByName(labels)
    return done.select(*GROUP, "point_id", "cluster")
