"""Second looks, pixels, bundles and files: loops beside what SQL can't say."""

import json

import numpy as np
from pyspark.sql import functions as F

from gaugeframe.functions import geometry as G
from gaugeframe.operators import boxes as B
from gaugeframe.operators import ink, vote
from gaugeframe.plans.queries import INK, QUERIES
from gaugeframe.plans.views import view
from gaugeframe.sources import files

SF = "/root/testdata/sf0.001"


def test_bands_by_loop():
    def slow(m, char, min_area, min_gap):
        need = max(2.0, m.shape[1] * 0.07)
        out, at = [], None
        for i in range(m.shape[0] + 1):
            if i < m.shape[0] and m[i].sum() >= need:
                at = [i, i + 1] if at is None else [at[0], i + 1]
            elif at is not None:
                if out and (at[0] - out[-1][1] <= max(2, int(char * 0.35)) or at[0] - out[-1][1] < min_gap):
                    out[-1][1] = at[1]
                else:
                    out.append(at)
                at = None
        kept = []
        for a, b in out:
            if b - a >= max(3, int(char * 0.55)) and m[a:b].sum() >= min_area and m[a:b].any():
                x = [k for k in range(m.shape[1]) if m[a:b, k].any()]
                kept.append((a, b - a, x[0], x[-1] - x[0] + 1))
        return kept

    rng = np.random.default_rng(1)
    for _ in range(300):
        m = np.repeat(rng.random((rng.integers(1, 20), 1)) < 0.5, 4, axis=0) & (rng.random((1, rng.integers(1, 15))) < 0.6)
        char, gap = float(rng.integers(4, 12)), float(rng.integers(0, 9))
        assert ink.bands(m, char, 6.0, gap) == slow(m, char, 6.0, gap)
    assert ink.bands(np.zeros((0, 0), bool), 4.0, 1.0) == []


def test_blobs(spark):
    tall = np.zeros((60, 12), np.uint8)
    tall[:15], tall[40:] = 1, 1
    rows = [("a", 1, 5.0, 7.0, 12.0, 60.0, bytearray(tall.tobytes())), ("a", 2, 0.0, 0.0, 60.0, 12.0, bytearray(tall.T.tobytes())), ("b", 1, 1.0, 1.0, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "page_id string, box_id int, x double, y double, w double, h double, mask binary")
    got = {(r.page_id, r.box_id, r.part): (r.x, r.y, r.w, r.h) for r in ink.refine_blobs(df).collect()}
    assert got == {("a", 1, 0): (5, 7, 12, 15), ("a", 1, 1): (5, 47, 12, 20), ("a", 2, 0): (0, 0, 15, 12), ("a", 2, 1): (40, 0, 20, 12), ("b", 1, 0): (1, 1, 9, 9)}
    assert ink.refine_blobs(df.limit(0)).count() == 0
    parts = {r.page_id % 2: r.n for r in QUERIES["ink_bands"](spark, SF).groupBy("page_id", "box_id").agg(F.count("*").alias("n")).select("page_id", "n").distinct().collect()}
    assert parts == {0: 1, 1: 2}


def test_gray(spark):
    x = np.array([[[255, 255, 255], [0, 0, 0]], [[55, 155, 255], [255, 0, 0]]], np.uint8)
    assert ink.cad_gray(x).tolist() == [[0, 255], [150, 0]]
    df = spark.createDataFrame([(1, 2, 2, bytearray(x.tobytes())), (2, 2, 2, None), (3, 2, 2, bytearray(b"1"))], "page_id int, width int, height int, data binary")
    assert {r.page_id: r.gray and list(r.gray) for r in ink.gray_pictures(df).collect()} == {1: [0, 255, 150, 0], 2: None, 3: None}


def test_dedupe_boxes_by_loop(spark):
    got = {(r.page_id, r.box_id) for r in QUERIES["dedupe_boxes"](spark, SF).collect()}
    pages, want = {}, set()
    for r in view(spark, SF, "boxes").withColumn("fill", F.expr(INK)).collect():
        pages.setdefault(r.page_id, []).append(r)
    for page, rows in pages.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.fill, r.box_id)):
            area = lambda k, r=r: max(0, min(k.x + k.w, r.x + r.w) - max(k.x, r.x)) * max(0, min(k.y + k.h, r.y + r.h) - max(k.y, r.y)) / min(max(k.w * k.h, 1), max(r.w * r.h, 1))
            if all(area(k) < 0.5 for k in kept):
                kept.append(r)
        want |= {(page, r.box_id) for r in kept}
    assert got == want


def test_expand(spark):
    schema = "page_id long, box_id long, x double, y double, w double, h double, cluster_id long"
    d = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 300.0, 1), (1, 2, 200.0, 10.0, 20.0, 30.0, 2), (1, 3, 300.0, 10.0, 20.0, 30.0, 3), (2, 1, 10.0, 10.0, 20.0, 300.0, 1)], schema)
    looks = spark.createDataFrame([(1, 1, 1, 4.0, 4.0, 20.0, 40.0), (1, 1, 2, 4.0, 200.0, 20.0, 40.0), (1, 2, 1, 0.0, 0.0, 5.0, 5.0), (2, 1, 1, 4.0, 4.0, 20.0, 40.0)], "page_id long, cluster_id long, box_id long, x double, y double, w double, h double")
    got = sorted(tuple(r) for r in B.expand(d, looks, 600.0, 400.0).select("page_id", "x", "y", "w", "h", "cluster_id").collect())
    assert got == [(1, 10.0, 10.0, 20.0, 40.0, 4), (1, 10.0, 206.0, 20.0, 40.0, 5), (1, 200.0, 10.0, 20.0, 30.0, 2), (1, 300.0, 10.0, 20.0, 30.0, 3), (2, 10.0, 10.0, 20.0, 300.0, 1)]
    clusters = lambda d: d.select("page_id", "cluster_id").distinct().count()
    assert clusters(QUERIES["expand_clusters"](spark, SF)) > clusters(QUERIES["cluster_components"](spark, SF))


def test_recognise(spark):
    c = spark.createDataFrame([("a", 1, "215.37±0.05", 0.97), ("b", 1, "12.5", 0.5), ("b", 2, "12.5", 0.6), ("c", 1, " ", 0.9), ("d", 1, "45 10'", 0.99)], "crop_id string, seq int, text string, conf double")
    s = spark.createDataFrame([("a", "Ø", 0.25, True), ("b", "R", 0.0, None)], "crop_id string, prefix string, diameter_score double, vertical boolean")
    s = s.withColumns({k: F.lit(False) for k in ("plus_minus", "degree", "radius")})
    got = {r.crop_id: (r.text, r.kind, r.prefix_used, r.needs_review) for r in vote.recognise(c, s).collect()}
    assert got == {"a": ("Ø215.37±0.05", "diameter", True, False), "b": ("R12.5", "radius", True, True), "d": ("45°10'", "angle", False, False)}
    assert vote.recognise(c.limit(0), s).count() == 0
    assert QUERIES["recognise"](spark, SF).count() > 0


def test_provider(spark):
    df = spark.createDataFrame([("a", bytearray(b"12 34")), ("b", None)], "crop_id string, data binary")
    made = vote.read_crops(df, lambda: lambda data: [(w.decode(), 0.5, 0.0, 0.0, 1.0, 1.0) for w in data.split()])
    assert [(r.crop_id, r.seq, r.text) for r in made.orderBy("seq").collect()] == [("a", 0, "12"), ("a", 1, "34")]


def test_text_box_outside(spark):
    size = lambda w, h: F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"))
    box = G.box(*[F.lit(v) for v in (0.0, 0.0, 20.0, 20.0)])
    r = spark.range(1).select(G.text_box(box, size(100.0, 50.0), size(280.0, 150.0), size(280.0, 150.0), F.lit(False)).alias("b")).first()
    assert r.b is None


def test_bundles_and_templates(spark, tmp_path):
    for r in QUERIES["project_bundles"](spark, SF).collect():
        j = json.loads(r.json)
        numbers = [a["number"] for a in j["annotations"]]
        assert j["projectName"] == r.project_id and numbers == sorted(numbers) and numbers
    back = files.parse_bundles(QUERIES["project_bundles"](spark, SF).select(F.col("json").alias("value")))
    assert back.where("error is not null").count() == 0
    t = spark.createDataFrame([("A", '{"x":1}'), ("B", "{}")], "template_id string, json string")
    assert sorted(files.save_templates(t, str(tmp_path))) == [("A", False), ("B", False)]
    assert sorted(files.save_templates(t, str(tmp_path))) == [("A", True), ("B", True)]
    assert (tmp_path / "A.json").read_text() == '{\n  "x": 1\n}\n'


def test_pictures(spark, tmp_path):
    for name in ("a.PNG", "b.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert files.pictures(spark, str(tmp_path)).count() == 2
