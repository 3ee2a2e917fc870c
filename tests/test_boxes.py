"""Box operators beside loops, on pages of every size."""

import random

from pyspark.sql import functions as F

from gaugeframe.operators import boxes as B


def absorbed(rows, anchor_area=650.0, gap=20.0, least=0.35):
    """rows (id, axis, x, y, w, h) of a page: the owner of each, one after the other."""
    at = {r[0]: tuple(r[2:]) for r in rows}
    first = {r[0]: r[1] for r in rows}
    anchors = [i for i, r in at.items() if r[2] * r[3] >= anchor_area]
    owner = {i: i for i in at}
    for i, r in at.items():
        best = None
        for a in [] if i in anchors else anchors:
            q, on = at[a], first[a] if first[i] == "square" else first[i]
            if on == "square" or (first[i] != "square" and first[i] != first[a]):
                continue
            k, s = (1, 0) if on == "vertical" else (0, 1)
            apart = max(0.0, q[k] - r[k] - r[k + 2], r[k] - q[k] - q[k + 2])
            shared = max(0.0, min(r[s] + r[s + 2], q[s] + q[s + 2]) - max(r[s], q[s])) / max(1.0, min(r[s + 2], q[s + 2]))
            if shared >= least and apart <= gap and (best is None or apart < best[0]):
                best = (apart, a)
        if best:
            owner[i], q = best[1], at[best[1]]
            x, y = min(q[0], r[0]), min(q[1], r[1])
            at[best[1]] = (x, y, max(q[0] + q[2], r[0] + r[2]) - x, max(q[1] + q[3], r[1] + r[3]) - y)
    return owner


def test_absorb_fragments_by_loop(spark):
    rng, pages = random.Random(5), {}
    for page in range(300):
        n = 400 if page in (7, 8) else rng.randint(1, 12)
        pages[page] = [(i, rng.choice(["vertical", "horizontal", "square"]), rng.randint(0, 900) / 3, rng.randint(0, 600) / 3, rng.randint(3, 120) / 3, rng.randint(3, 150) / 3) for i in range(n)]
    rows = [(p, *r) for p, rs in pages.items() for r in rs]
    d = spark.createDataFrame(rows, "page_id long, cluster_id long, axis string, x double, y double, w double, h double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # pages over many batches, and many in one
    try:
        out = B.absorb_fragments(d.drop("axis"), d.select("page_id", "cluster_id", "axis"))
        got = {(r.page_id, r.cluster_id): r.anchor_id for r in out.collect()}
        empty = B.absorb_fragments(d.drop("axis").where("page_id < 0"), d.select("page_id", "cluster_id", "axis"))
        assert empty.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(p, i): a for p, rs in pages.items() for i, a in absorbed(rs).items()}
    assert got == want and sum(i != a for (_, i), a in want.items()) > 100
    # a call of Python a batch, not a page
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_components_by_loop(spark):
    rng, rows = random.Random(9), []
    for page in range(40):
        n = 900 if page == 3 else rng.randint(2, 30)
        ids = rng.sample(range(5000), n)
        pairs = list(zip(ids, ids[1:], strict=False)) if page == 3 else [tuple(rng.sample(ids, 2)) for _ in range(n // 2)]
        rows += [(f"p{page}", min(i, j), max(i, j)) for i, j in pairs]
    up = {}
    top = lambda k: k if up.setdefault(k, k) == k else top(up[k])
    for page, i, j in rng.sample(rows, len(rows)):
        x, y = sorted((top((page, i)), top((page, j))))
        up[y] = x
    pairs = spark.createDataFrame(rows, "page_id string, box_id long, other_id long")
    nodes = pairs.select("page_id", "box_id").union(pairs.select("page_id", "other_id")).distinct().union(spark.createDataFrame([("p0", 9999), ("q", 1)], "p string, b long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        out = B.components(nodes, pairs)
        got = {(r.page_id, r.box_id): r.cluster_id for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: top(k)[1] for k in up} | {("p0", 9999): 9999, ("q", 1): 1}
    assert "MapInPandas" not in out._jdf.queryExecution().toString()
