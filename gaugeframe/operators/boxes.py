"""Boxes of a page: boxes(page_id, box_id, x, y, w, h).  Pairs meet inside a page only, by an
equi-join on page_id with the geometry as a residual condition; what is sequential by
nature runs in Arrow batches of whole pages, all of a batch's pages at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import text as X
from ..sources.tables import materialise


def BOX():
    return F.struct("x", "y", "w", "h")


def _pairs(boxes: DataFrame, ordered: bool) -> DataFrame:
    d = boxes.select("page_id", "box_id", BOX().alias("a"))
    e = d.select("page_id", F.col("box_id").alias("other_id"), F.col("a").alias("b"))
    return d.join(e, "page_id").where(F.col("box_id") < F.col("other_id") if ordered else F.col("box_id") != F.col("other_id"))


def merge_pairs(boxes: DataFrame, ratio: float = 0.6, width: float = 0.0, height: float = 0.0) -> DataFrame:
    """(page_id, box_id, other_id) of the boxes that belong to one dimension."""
    a, b = F.col("a"), F.col("b")
    return _pairs(boxes, True).where(G.should_merge(a, b, ratio) & G.within_caps(a, b, width, height)).select("page_id", "box_id", "other_id")


def bridges(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id) of boxes that cross two perpendicular boxes which don't meet each other."""
    a, b = F.col("a"), F.col("b")
    across = (G.axis(a) != "square") & (G.axis(b) != "square") & (G.axis(a) != G.axis(b))
    crossed = _pairs(boxes, False).where(across & G.touch(G.rect(a), G.rect(b))).select("page_id", "box_id", "other_id", "b")
    second = crossed.select("page_id", "box_id", F.col("other_id").alias("third_id"), F.col("b").alias("c"))
    apart = crossed.join(second, ["page_id", "box_id"]).where((F.col("other_id") < F.col("third_id")) & ~G.touch(G.rect(b), G.rect(F.col("c"))))
    return apart.select("page_id", "box_id").distinct()


def drop_bridges(boxes: DataFrame) -> DataFrame:
    return boxes.join(bridges(boxes), ["page_id", "box_id"], "left_anti")


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, box_id, cluster_id): connected components inside each page, named by the smallest id.
    Pairs are dealt by page and read page after page; a box without a pair is its own component."""

    def run(batches):
        import pyarrow as pa

        for t in _whole_pages(batches):
            starts, n = _starts(t.column(0)), t.num_rows
            page = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
            ids = pa.concat_arrays([*t.column(1).chunks, *t.column(2).chunks])
            values, rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            _, at, node = np.unique(np.concatenate([page, page]) * len(values) + rank, return_index=True, return_inverse=True)
            least = at[_least(node[:n], node[n:], len(at))]
            out = [t.column(0).combine_chunks().take(pa.array(at % n)), ids.take(pa.array(at)), ids.take(pa.array(least))]
            yield from pa.table(out, names=["page_id", "box_id", "cluster_id"]).to_batches(max_chunksize=100_000)

    kind = lambda c: nodes.schema[c].dataType.simpleString()
    edges = pairs.select("page_id", "box_id", "other_id").repartition("page_id").sortWithinPartitions("page_id")
    found = edges.mapInArrow(run, f"page_id {kind('page_id')}, box_id {kind('box_id')}, cluster_id {kind('box_id')}")
    out = nodes.select("page_id", "box_id").join(found, ["page_id", "box_id"], "left")
    return out.withColumn("cluster_id", F.coalesce("cluster_id", "box_id"))


def _least(i, j, n: int):
    """The smallest node of each node's component; edges i, j between n nodes."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def clusters(boxes: DataFrame, ratio: float = 0.6, width: float = 0.0, height: float = 0.0) -> DataFrame:
    """boxes with cluster_id."""
    return boxes.join(components(boxes, merge_pairs(boxes, ratio, width, height)), ["page_id", "box_id"])


def bounds(clustered: DataFrame) -> DataFrame:
    """One box a cluster: the union of its members."""
    u = clustered.groupBy("page_id", "cluster_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count("*").alias("n_boxes")
    )
    return u.select("page_id", "cluster_id", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), "n_boxes")


def order(cluster_boxes: DataFrame) -> DataFrame:
    """cluster boxes with ``place``: by bands of the mean height, then x, inside a page."""
    band = F.greatest(F.avg("h").over(Window.partitionBy("page_id")), F.lit(1.0))
    d = cluster_boxes.withColumn("band", F.rint(F.col("y") / band))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("band", "x", "cluster_id"))).drop("band")


def split_mixed(clustered: DataFrame) -> DataFrame:
    """A cluster that holds vertical and horizontal boxes falls into one per axis."""
    w = Window.partitionBy("page_id", "cluster_id")
    d = clustered.withColumn("axis", G.axis(BOX()))
    both = F.bool_or(F.col("axis") == "vertical").over(w) & F.bool_or(F.col("axis") == "horizontal").over(w)
    part = F.when(F.col("axis") == "vertical", 0).when(F.col("axis") == "horizontal", 1).otherwise(2)
    return d.withColumn("part", F.when(both, part).otherwise(0)).drop("axis")


def overlapping_clusters(cluster_boxes: DataFrame, least: float = 0.1) -> DataFrame:
    """(page_id, cluster_id, merged_id) of clusters joined where they overlap."""
    n = cluster_boxes.withColumnRenamed("cluster_id", "box_id")
    p = _pairs(n, True).where(G.overlap_fraction(F.col("a"), F.col("b")) >= least).select("page_id", "box_id", "other_id")
    return components(n, p).select("page_id", F.col("box_id").alias("cluster_id"), F.col("cluster_id").alias("merged_id"))


def first_axes(clustered: DataFrame) -> DataFrame:
    """(page_id, cluster_id, axis): the axis of each cluster's first box."""
    return clustered.groupBy("page_id", "cluster_id").agg(F.min_by(BOX(), "box_id").alias("b")).select("page_id", "cluster_id", G.axis(F.col("b")).alias("axis"))


def absorb_fragments(cluster_boxes: DataFrame, axes: DataFrame, anchor_area: float = 650.0, gap: float = 20.0, least: float = 0.35) -> DataFrame:
    """(page_id, cluster_id, anchor_id): fragments join the nearest anchor on their axis, which is that
    of a cluster's first box (axes); an anchor grows with each, so the order of cluster_id counts."""

    k = lambda c: cluster_boxes.schema[c].dataType.simpleString()
    d = cluster_boxes.join(axes, ["page_id", "cluster_id"]).select("page_id", "cluster_id", "axis", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    d = d.withColumn("axis", F.when(F.col("axis") == "vertical", 1).when(F.col("axis") == "horizontal", 2).otherwise(0).cast("byte"))

    def run(batches):
        import pyarrow as pa

        for t in _whole_pages(batches):
            starts = _starts(t.column(0))
            owner = _absorb(starts, *[t.column(i).to_numpy() for i in range(2, 7)], anchor_area, gap, least)
            t = pa.table([t.column(0), t.column(1), t.column(1).take(pa.array(owner))], names=["page_id", "cluster_id", "anchor_id"])
            yield from t.to_batches(max_chunksize=100_000)

    d = d.repartition("page_id").sortWithinPartitions("page_id", "cluster_id")
    return d.mapInArrow(run, f"page_id {k('page_id')}, cluster_id {k('cluster_id')}, anchor_id {k('cluster_id')}")


def _starts(pages):
    """Where each page begins."""
    import pyarrow.compute as pc

    pages = pages.combine_chunks()
    new = pc.not_equal(pages.slice(1), pages.slice(0, max(len(pages) - 1, 0))).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _whole_pages(batches):
    """Tables of whole pages from batches that are sorted by page."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        first = 0 if not held or b.column(0)[0] != held[-1].column(0)[-1] else None
        last = _starts(pa.chunked_array([b.column(0)]))[-1]
        if first is None and last == 0:
            held.append(b)  # the held page goes on
            continue
        whole = [*held, b.slice(0, last)]
        held = [b.slice(last)]
        whole = pa.Table.from_batches(whole)
        if whole.num_rows:
            yield whole
    if held:
        yield pa.Table.from_batches(held)


def _absorb(starts, axis, x, y, w, h, anchor_area: float, gap: float, least: float):
    """The row that each row joins, itself if none; rows by page and id.  All pages at once: in turn k their
    k-th fragments look at their pages' anchors, which grow for the next turn."""
    n = len(axis)
    x, y, x1, y1 = x.copy(), y.copy(), x + w, y + h
    w, h = w.copy(), h.copy()
    page = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    anchor, owner = w * h >= anchor_area, np.arange(n)
    anchors, fragments = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    count = np.bincount(page[anchors], minlength=len(starts))
    offset = np.cumsum(count) - count
    fragments = fragments[count[page[fragments]] > 0]
    if not len(fragments):
        return owner
    p = page[fragments]
    turn = np.arange(len(p)) - np.searchsorted(p, p)
    by_turn = np.argsort(turn, kind="stable")
    bounds = np.cumsum(np.bincount(turn))
    for lo, hi in zip([0, *bounds[:-1]], bounds, strict=True):
        f = fragments[by_turn[lo:hi]]
        many = count[page[f]]
        ends = np.cumsum(many)
        i = np.repeat(f, many)
        a = anchors[np.arange(len(i)) - np.repeat(ends - many, many) + np.repeat(offset[page[f]], many)]
        on = np.where(axis[i] == 0, axis[a], axis[i])
        up = on == 1
        r0, rn, q0, qn = np.where(up, y[i], x[i]), np.where(up, h[i], w[i]), np.where(up, y[a], x[a]), np.where(up, h[a], w[a])
        apart = np.maximum(0.0, np.maximum(q0 - r0 - rn, r0 - q0 - qn))
        s0, s1, t0, t1 = np.where(up, x[i], y[i]), np.where(up, x1[i], y1[i]), np.where(up, x[a], y[a]), np.where(up, x1[a], y1[a])
        shared = np.maximum(0.0, np.minimum(s1, t1) - np.maximum(s0, t0)) / np.maximum(1.0, np.minimum(np.where(up, w[i], h[i]), np.where(up, w[a], h[a])))
        fits = (on != 0) & ((axis[i] == 0) | (axis[i] == axis[a])) & (shared >= least) & (apart <= gap)
        apart = np.where(fits, apart, np.inf)
        nearest = np.minimum.reduceat(apart, ends - many)
        won = np.flatnonzero((apart == np.repeat(nearest, many)) & fits)
        _, once = np.unique(i[won], return_index=True)  # of equally near ones the first
        i, a = i[won[once]], a[won[once]]
        owner[i] = a
        x[a], y[a], x1[a], y1[a] = np.minimum(x[a], x[i]), np.minimum(y[a], y[i]), np.maximum(x1[a], x1[i]), np.maximum(y1[a], y1[i])
        w[a], h[a] = x1[a] - x[a], y1[a] - y[a]
        x1[a], y1[a] = x[a] + w[a], y[a] + h[a]
    return owner


def _greedy(rows: DataFrame, rank, limit: float) -> DataFrame:
    """Rows in rank order that overlap no row kept before by ``limit`` or more."""
    item = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)], F.col("box_id").alias("id"), BOX().alias("b"))
    d = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.filter(F.col("items"), lambda _: F.lit(False))
    kept = F.aggregate(
        "items", empty, lambda acc, x: F.when(F.exists(acc, lambda k: G.overlap_fraction(k.b, x.b) >= limit), acc).otherwise(F.array_append(acc, x))
    )
    ids = d.select("page_id", F.explode(F.transform(kept, lambda k: k.id)).alias("box_id"))
    return rows.join(ids, ["page_id", "box_id"], "left_semi")


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """regions(page_id, box_id, x, y, w, h, text, conf): of overlapping ones the richest text stays."""
    t = F.coalesce("text", F.lit(""))
    rank = [-F.regexp_count(t, F.lit("[ØøφΦ°±]")), -F.regexp_count(t, F.lit(r"\d")), -F.length(F.trim(t)), -F.coalesce("conf", F.lit(0.0))]
    return _greedy(regions, rank, 0.5)


def dedupe_boxes(boxes: DataFrame, limit: float = 0.5) -> DataFrame:
    """boxes(…, fill): of overlapping ones the fullest of ink stays."""
    return _greedy(boxes, [-F.col("fill")], limit)


def uncovered(ocr: DataFrame, vision: DataFrame, least: float = 0.72) -> DataFrame:
    """OCR boxes that aren't tiny nor mostly inside a vision box, after the vision boxes."""
    big = ocr.where((F.least("w", "h") >= 11) & (F.col("w") * F.col("h") >= 180))
    v = vision.select("page_id", BOX().alias("v"))
    inside = big.select("page_id", "box_id", BOX().alias("o")).join(v, "page_id")
    inside = inside.where(G.overlap_area(F.col("o"), F.col("v")) >= least * F.greatest(F.col("o.w") * F.col("o.h"), F.lit(1.0))).select("page_id", "box_id")
    return vision.unionByName(big.join(inside.distinct(), ["page_id", "box_id"], "left_anti"))


def right_limits(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, right_limit): 8 short of the nearest box at the right on the same lines."""
    a, b = F.col("a"), F.col("b")
    beside = (b.x >= a.x + a.w) & (b.y <= a.y + a.h) & (a.y <= b.y + b.h)
    near = _pairs(boxes, False).where(beside).groupBy("page_id", "box_id").agg((F.min(b.x) - 8).alias("right_limit"))
    return boxes.select("page_id", "box_id").join(near, ["page_id", "box_id"], "left")


def oversized(cluster_boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Cluster boxes with ``oversized``, against the page's upper middle height."""
    hs = F.col("hs")
    middle = cluster_boxes.groupBy("page_id").agg(F.sort_array(F.collect_list("h")).alias("hs")).select("page_id", F.element_at(hs, F.floor(F.size(hs) / 2).cast("int") + 1).alias("_middle"))
    d = cluster_boxes.join(middle, "page_id")
    large = (F.col("h") > F.greatest(2.8 * F.col("_middle"), F.lit(0.28 * height))) | (F.col("w") > 0.38 * width) | (F.col("w") * F.col("h") > 0.07 * width * height)
    return d.withColumn("oversized", large).drop("_middle")


def segment(boxes: DataFrame, ratio: float = 0.72, width: float = 0.0, height: float = 0.0, looks: DataFrame | None = None, clustered: DataFrame | None = None) -> DataFrame:
    """The page's dimensions as ordered boxes: bridges go, boxes cluster, fragments join their
    anchors, clusters of two axes split, second looks (detections, see ``expand``) replace oversized
    ones, and overlapping ones merge.  ``clustered``: the boxes' clusters without bridges, if they are there."""
    # each step's result is read several times: it is written once
    d = clustered if clustered is not None else materialise(clusters(drop_bridges(boxes), ratio, width, height))
    d = d.join(absorb_fragments(bounds(d), first_axes(d)), ["page_id", "cluster_id"]).drop("cluster_id").withColumnRenamed("anchor_id", "cluster_id")
    d = materialise(split_mixed(d).withColumn("cluster_id", F.col("cluster_id") * 3 + F.col("part")).drop("part"))
    if looks is not None:
        d = materialise(expand(d, looks, width, height, ratio))
    d = d.join(overlapping_clusters(bounds(d)), ["page_id", "cluster_id"]).drop("cluster_id").withColumnRenamed("merged_id", "cluster_id")
    return order(bounds(d))


def regions(ordered: DataFrame, readings: DataFrame, rereads: DataFrame, width: float, height: float) -> DataFrame:
    """Regions of ordered cluster boxes that were read: readings(page_id, cluster_id, text, conf, type).
    Crops under a pixel and texts that are no dimension go, cut-off angles are completed from rereads
    (page_id, box_id: the cluster, text, conf, box), and of overlapping regions the richest stays."""
    c = G.crop_rect(BOX(), F.lit(width), F.lit(height), 6)
    d = ordered.where((c.w >= 1) & (c.h >= 1)).join(readings, ["page_id", "cluster_id"])
    d = d.withColumn("text", X.strip(F.coalesce("text", F.lit("")))).where((F.col("text") != "") & C.is_segment_worthy(F.col("text")))
    d = d.select("page_id", F.col("cluster_id").alias("box_id"), *[F.round(F.col(k), 1).alias(k) for k in "xywh"], "text", "conf", "type", "place")
    return dedupe_regions(materialise(complete_angles(materialise(d), rereads, width)))


def proposals(upright: DataFrame, turned: DataFrame, width: float, height: float, least_fill: float = 0.025) -> DataFrame:
    """Boxes of both passes over a picture: upright as they are, turned ones (found in the picture turned
    clockwise) turned back; cut to the picture, without specks and boxes with next to no ink, the
    fullest of overlapping ones.  Both: (page_id, box_id, x, y, w, h, ink)."""
    back = turned.withColumn("b", G.unrotate_pass(BOX(), F.lit(float(height)))).withColumns({k: F.col(f"b.{k}") for k in "xywh"}).drop("b")
    top = upright.groupBy("page_id").agg(F.max("box_id").alias("_top"))
    back = back.join(top, "page_id", "left").withColumn("box_id", F.col("box_id") + F.coalesce("_top", F.lit(0))).select(upright.columns)
    d = upright.unionByName(back)
    x0, y0 = F.greatest(F.col("x"), F.lit(0.0)), F.greatest(F.col("y"), F.lit(0.0))
    x1, y1 = F.least(F.col("x") + F.col("w"), F.lit(float(width))), F.least(F.col("y") + F.col("h"), F.lit(float(height)))
    d = d.withColumns({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}).where("w >= 1 and h >= 1")
    d = d.withColumn("fill", F.col("ink") / F.greatest(F.col("w") * F.col("h"), F.lit(1.0))).where(F.col("fill") >= least_fill)
    return dedupe_boxes(d)


def expand(clustered: DataFrame, detections: DataFrame, width: float, height: float, ratio: float = 0.72) -> DataFrame:
    """Boxes with cluster_id, after a second look into oversized clusters: detections(page_id, cluster_id,
    box_id, x, y, w, h in the cluster's crop) replace a cluster if they form more than one.  New
    cluster ids and box ids follow the page's largest."""
    keys = ["page_id", "cluster_id"]
    large = oversized(bounds(clustered), width, height).where("oversized").select(*keys, G.crop_rect(BOX(), F.lit(width), F.lit(height), 4).alias("c"))
    found = materialise(detections.join(large, keys).withColumns({"x": F.round(F.col("x") + F.col("c.x"), 1), "y": F.round(F.col("y") + F.col("c.y"), 1)}))
    # each crop is a page of its own, named by its page and cluster
    crop = F.to_json(F.struct(*keys))
    names = found.select(crop.alias("crop"), *keys).distinct()
    inner = found.select(crop.alias("page_id"), "box_id", "x", "y", "w", "h", F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))
    a, b = F.col("a"), F.col("b")
    caps = inner.select("page_id", "cw", "ch").distinct()
    w, h = G.union_size(a, b)
    pairs = _pairs(inner, True).join(caps, "page_id").where(G.should_merge(a, b, ratio) & (w <= 0.34 * F.col("cw")) & (h <= 0.42 * F.col("ch")))
    sub = split_mixed(inner.drop("cw", "ch").join(components(inner, pairs), ["page_id", "box_id"]))
    sub = materialise(sub.withColumnRenamed("page_id", "crop").withColumnRenamed("cluster_id", "sub_id").join(names, "crop"))
    many = sub.groupBy(*keys).agg(F.count_distinct("sub_id", "part").alias("n")).where("n > 1").select(*keys)
    sub = sub.join(many, keys, "left_semi")
    top = clustered.groupBy("page_id").agg(F.max("cluster_id").alias("top_cluster"), F.max("box_id").alias("top_box"))
    page = Window.partitionBy("page_id")
    sub = sub.join(top, "page_id").withColumns({
        "new_cluster": F.col("top_cluster") + F.dense_rank().over(page.orderBy("cluster_id", "sub_id", "part")),
        "new_box": F.col("top_box") + F.row_number().over(page.orderBy("cluster_id", "box_id")),
    })
    new = sub.select("page_id", F.col("new_box").alias("box_id"), "x", "y", "w", "h", F.col("new_cluster").alias("cluster_id"))
    return clustered.select(*new.columns).join(many, keys, "left_anti").unionByName(new)


def complete_angles(regions: DataFrame, rereads: DataFrame, width: float) -> DataFrame:
    """regions(page_id, box_id, x, y, w, h, text, conf, type) with angles whose end was cut off read anew:
    rereads(page_id, box_id, text, conf, box struct or null) are readings of the grown crops.  Accepted
    only where the crop had room to grow and the reading is an angle of more digits.  Room is judged by
    the boxes as they came."""
    keys = ["page_id", "box_id"]
    r = rereads.select(*keys, X.parse_dms(X.strip(F.col("text"))).alias("new_text"), F.col("conf").alias("new_conf"), F.col("box").alias("new_box"))
    d = regions.join(right_limits(regions), keys).join(r, keys, "left")
    old = X.strip(F.coalesce("text", F.lit("")))
    whole = X.parse_dms(old).isNotNull() & old.contains("'") & old.contains('"')
    digits = lambda c: F.regexp_count(c, F.lit(r"\d"))
    room = G.grown_right(BOX(), F.col("right_limit"), F.lit(float(width))).isNotNull()
    take = (F.col("type") == "angle") & ~whole & room & (digits(F.col("new_text")) > digits(old))
    take = F.coalesce(take, F.lit(False))
    boxed = take & F.col("new_box").isNotNull()
    moved = {c: F.when(boxed, F.round(F.col(f"new_box.{c}"), 1)).otherwise(F.col(c)) for c in "xywh"}
    text = {"text": F.when(take, F.col("new_text")).otherwise(F.col("text")), "conf": F.when(take, F.col("new_conf")).otherwise(F.col("conf"))}
    return d.withColumns(moved | text).select(regions.columns)
