"""Worked cases of the inspection operators, and loops beside what SQL can't say."""

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import classify as C
from gaugeframe.functions import ids, ranges
from gaugeframe.functions import text as X
from gaugeframe.operators import boxes as B
from gaugeframe.operators import sheet, store, template, vote
from gaugeframe.plans.views import view
from gaugeframe.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, f, *values):
    """f over a column of strings, as a list."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_dms(spark):
    assert one(spark, X.parse_dms, "32\"20'40\"", "32°20'40\"", "32 20'40\"", "45.5°", "215,37", "203.20", '40"', "10°61'", "999°", None) == [
        "32°20'40\"", "32°20'40\"", "32°20'40\"", "45.5°", None, None, None, None, "999°", None]
    assert one(spark, lambda t: X.parse_dms(t, False), "45", "1234") == ["45°", None]


def test_cad(spark):
    got = one(spark, X.normalize_cad_number, "215.37±0.05", "32\"20'40\"", "215,370.05", "174.07+0.05", "215,37,05", "215,37", '40"', "FINISH TURNED", "50.22,05", "12.5.1")
    assert got == ["215.37±0.05", "32°20'40\"", "215.37±0.05", "174.07±0.05", "215.3±7.05", "215,37", "40", "FINISH TURNED", "50.22±0.05", "12.5±0.01"]


def test_confusables(spark):
    got = one(spark, X.correct_confusables, "1OO", "OO1", "BOLT", "S8", "", None)
    assert [g and tuple(g) for g in got] == [("100", True), ("O01", True), ("BOLT", False), ("58", True), ("", False), None]


def test_confusables_query_by_loop(spark):
    from gaugeframe.plans.queries import QUERIES

    def fold(t):
        c = list(t)
        for i, ch in enumerate(c):
            if ch in X.CONFUSABLES and ((i and c[i - 1].isdigit()) or (i + 1 < len(c) and c[i + 1].isdigit())):
                c[i] = X.CONFUSABLES[ch]
        return "".join(c)

    for r in QUERIES["confusables"](spark, SF).limit(500).collect():
        assert r.fixed == fold(r.misread) and r.changed == (r.fixed != r.misread)


def test_worthy_and_symbols(spark):
    assert one(spark, C.is_segment_worthy, "Ø215.37±0.05", "32°20'40\"", ".05", "05", "215.", "174.", "12345", None) == [True, True, False, False, False, False, False, False]
    assert one(spark, X.fix_symbols, " φ 12 +/- 0.1 ", "r12", "12 ° 30 ′") == ["Ø12±0.1", "R12", "12°30'"]
    assert one(spark, X.fix_symbols_client, "r12 ± 1") == ["r12±1"]
    assert one(spark, lambda t: X.leading_symbol(t).symbol, "ø 12", "r5", "12") == ["Ø", "R", ""]


def test_ranges(spark):
    rows = [("58.21±0.05", "+0.05, -0.05"), ("24°31'16\"", ""), ("5 ~ 7", ""), ("n 3 MAX", None), ("4 min", ""), ("50,22±0.05", "±0.1"), (None, None), ("x", "±1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, t string")
    got = [r.r and tuple(r.r) for r in ranges.with_range(df, F.col("v"), F.col("t"), "r").orderBy("i").collect()]
    assert got == [(58.16, 58.26), None, (5.0, 7.0), (0.0, 3.0), (4.0, None), (49.9, 50.1), None, None]
    assert [r.t for r in spark.createDataFrame([(58.0,), (58.16,)], "x double").select(ranges.json_number(F.col("x")).alias("t")).collect()] == ["58", "58.16"]


def test_ids(spark):
    assert one(spark, ids.template_id, "C:\\untrusted\\path\\ts2 32224 cone inspection.json", "__.json") == ["TS2_32224_CONE_INSPECTION", None]
    assert one(spark, ids.template_name, "TS2_32224_CONE_INSPECTION") == ["TS2 32224 Cone Inspection"]
    assert one(spark, ids.safe_id, " Part 1 ", "part_1", "", None, "Ø") == ["part_1", "part_1", "x", "x", "x"]


def test_compose(spark):
    rows = [("Ø174.07±0.05", "", 0.0, False, False, False), ("174.07+0.05", "Ø", 0.0, False, False, False), ("O174.07", "", 0.9, False, False, False), ("12.5", "", 0.0, False, True, False),
            ("174.07±0.05", "", 0.0, False, False, True), ("32 20'40\"", "", 0.0, True, False, False), ("", "", 0.0, False, False, False), ("45", "", 0.0, False, False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, prefix string, diameter_score double, degree boolean, radius boolean, vertical boolean")
    got = [(r.composed, r.kind, r.applied) for r in vote.compose(df).orderBy("i").collect()]
    assert got[0][:2] == ("Ø174.07±0.05", "diameter") and got[1] == ("Ø174.07±0.05", "diameter", ["phi_prefix"]) or got[1][:2] == ("Ø174.07+0.05", "diameter")
    assert got[2] == ("Ø174.07", "diameter", ["leading_o_phi"]) and got[3] == ("R12.5", "radius", ["radius"])
    assert got[4][0] == "Ø174.07±0.05" and "vertical_dia_tol" in got[4][2]
    assert got[5][:2] == ("32°20'40\"", "angle") and got[6] == ("", "unknown", [])


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "page_id long, box_id long, x double, y double, w double, h double")


def clusters_of(spark, rows, ratio=0.6):
    return B.clusters(boxes(spark, rows), ratio).select("cluster_id").distinct().count()


def test_clusters(spark):
    assert clusters_of(spark, [(0, 0, 20, 40)]) == 1
    assert clusters_of(spark, [r for x in (10, 70, 130, 190, 250) for r in ((x, 20, 14, 40), (x, 64, 14, 30))]) == 5
    assert clusters_of(spark, [(10, 20, 14, 60), (80, 40, 30, 12), (112, 40, 28, 12)]) == 2
    assert clusters_of(spark, [(10, 20, 14, 70), (30, 95, 55, 12)]) == 2
    assert clusters_of(spark, [(10, 20, 14, 45), (10, 90, 14, 45)]) == 2
    kept = lambda rows: sorted(r.box_id for r in B.drop_bridges(boxes(spark, rows)).collect())
    assert kept([(83, 104, 22, 90), (159, 77, 36, 60), (91, 88, 97, 18)]) == [0, 1]
    assert kept([(90, 250, 35, 190), (690, 330, 35, 120), (300, 400, 110, 30)]) == [0, 1, 2]
    assert kept([(159, 77, 36, 60), (150, 120, 50, 20)]) == [0, 1]


def test_order_split_and_fragments(spark):
    b = boxes(spark, [(200, 10, 14, 40), (10, 10, 14, 40), (10, 200, 14, 40)]).withColumnRenamed("box_id", "cluster_id")
    assert [r.cluster_id for r in B.order(b).orderBy("place").collect()] == [1, 0, 2]
    mixed = boxes(spark, [(10, 20, 14, 60), (12, 95, 50, 12)]).withColumn("cluster_id", F.lit(0))
    assert B.split_mixed(mixed).select("part").distinct().count() == 2
    frag = boxes(spark, [(10, 20, 16, 72), (11, 24, 6, 8)]).withColumnRenamed("box_id", "cluster_id")
    own = frag.withColumnRenamed("cluster_id", "box_id").withColumn("cluster_id", F.col("box_id"))
    assert {r.cluster_id: r.anchor_id for r in B.absorb_fragments(frag, B.first_axes(own)).collect()} == {0: 0, 1: 0}
    # a square cluster whose first box is vertical takes fragments on the vertical axis
    two = boxes(spark, [(0, 0, 20, 40), (20, 0, 20, 40), (2, 45, 10, 20)]).withColumn("cluster_id", F.when(F.col("box_id") < 2, 0).otherwise(2))
    assert {r.cluster_id: r.anchor_id for r in B.absorb_fragments(B.bounds(two), B.first_axes(two)).collect()} == {0: 0, 2: 0}
    over = boxes(spark, [(300, 210, 48, 72), (285, 245, 111, 32)]).withColumnRenamed("box_id", "cluster_id")
    assert B.overlapping_clusters(over).select("merged_id").distinct().count() == 1
    u = B.bounds(boxes(spark, [(10, 20, 14, 40), (10, 64, 14, 30)]).withColumn("cluster_id", F.lit(0))).first()
    assert (u.x, u.y, u.w, u.h) == (10, 20, 14, 74)


def test_regions(spark):
    rows = [("Ø215,37±0.05", 90, 250, 35, 190, 0.9), ("Ø175.32REF.", 355, 215, 60, 130, 0.92), ("175REF", 350, 250, 111, 32, 0.71), ("203.20", 690, 330, 35, 120, 0.9)]
    df = spark.createDataFrame([(1, i, *map(float, r[1:5]), r[0], r[5]) for i, r in enumerate(rows)], "page_id long, box_id long, x double, y double, w double, h double, text string, conf double")
    assert [r.box_id for r in B.dedupe_regions(df).orderBy("box_id").collect()] == [0, 1, 3]


def test_nms_by_loop(spark):
    d = view(spark, SF, "boxes").withColumns({"text": F.concat("x", F.lit("±"), "y"), "conf": F.col("h") / 100})
    pages = {}
    for r in d.collect():
        pages.setdefault(r.page_id, []).append(r)
    want = set()
    for page, rs in pages.items():
        kept = []
        digits = lambda r: sum(c.isdigit() for c in f"{r.x}{r.y}")
        for r in sorted(rs, key=lambda r: (-digits(r), -len(f"{r.x}±{r.y}"), -r.h / 100, r.box_id)):
            def part(k, r=r):
                w, h = min(k.x + k.w, r.x + r.w) - max(k.x, r.x), min(k.y + k.h, r.y + r.h) - max(k.y, r.y)
                return max(w, 0) * max(h, 0) / min(max(k.w * k.h, 1), max(r.w * r.h, 1))

            if all(part(k) < 0.5 for k in kept):
                kept.append(r)
        want |= {(page, r.box_id) for r in kept}
    assert {(r.page_id, r.box_id) for r in B.dedupe_regions(d).collect()} == want


def test_recogniser_shapes(spark):
    box = "[[1,2],[21,2],[21,10],[1,10]]"
    rows = [(1, '{"res":{"rec_texts":["42.50"," "],"rec_scores":[0.98],"rec_polys":[%s]}}' % box), (2, '[[%s,["17.25",0.96]]]' % box), (3, '[["8.00",0.94]]'), (4, '{"rec_texts":["1"]}'), (5, "junk"), (6, None)]
    got = {r.crop_id: tuple(r)[2:] for r in files.ocr_lines(spark.createDataFrame(rows, "crop_id int, value string")).collect()}
    assert got == {1: ("42.50", 1, 2, 20, 8, 0.98), 2: ("17.25", 1, 2, 20, 8, 0.96), 3: ("8.00", 0, 0, 0, 0, 0.94), 4: ("1", 0, 0, 0, 0, 0)}


def test_template(spark, tmp_path):
    import json

    cells = [{"S.no": "1", "Label": "Outer diameter", "Value": "58.21±0.05", "Tolerance": "+0.05, -0.05"}, {"S.no": "2", "Label": "Face angle", "Value": "24°31'16\""}]
    rows = spark.createDataFrame([("TS2_1_CONE", i, c) for i, c in enumerate(cells)], "template_id string, pos int, cells map<string,string>")
    first = {(r.pos, r.id): (r.kind, r.min, r.max) for r in template.cells(rows, ["part1", "part2"]).where("id is not null").collect()}
    assert first[0, "row_1_part1"] == ("number", 58.16, 58.26) and first[1, "row_2_part1"] == ("text", None, None)
    doc = template.documents(rows, ["part1", "part2"]).first()
    parsed = json.loads(doc.json)
    assert list(parsed) == ["template_id", "template_name", "description", "version", "created_by", "items"]
    assert doc.row_count == 2 and len(parsed["items"]) == 3 and parsed["template_name"] == {"en": "TS2 1 Cone", "hi": "TS2 1 Cone"}
    head, row = parsed["items"][0]["items"], parsed["items"][1]["items"]
    assert [c["items"][0]["label"]["en"] for c in head] == ["S.No", "Label", "Value", "Tolerance", "Method", "Tool", "part1", "part2"]
    assert head[0]["items"][0]["style"] == {"font_size": 12, "vertical_alignment": "center", "horizontal_alignment": "center", "bold": True}
    assert row[6] == {
        "repeat_per_shift": "true/false", "depends_on_sections": [], "type": "Section", "Orientation": "Vertical", "fill": "uniform", "style": {"width": "23.5%"},
        "items": [{"id": "row_1_part1", "type": "number", "input_type": "text", "range": {"min": 58.16, "max": 58.26}, "required": False, "style": {"font_size": 11}}],
    }
    assert parsed["items"][2]["items"][7]["items"][0] == {"id": "row_2_part2", "type": "text", "input_type": "text", "required": False, "style": {"font_size": 11}}
    path = str(tmp_path / "t.json")
    assert files.save_json(doc.json, path) is False and files.save_json(doc.json, path) is True
    with pytest.raises(ValueError, match="no extra_columns"):
        template.cells(rows, [])
    (tmp_path / "in.json").write_text(json.dumps({"data": cells, "extra_columns": ["part1"]}))
    assert files.inspection_rows(spark, str(tmp_path / "in.json")).count() == 2
    (tmp_path / "bad.json").write_text('{"rows": []}')
    with pytest.raises(Exception, match="no data list"):
        files.inspection_rows(spark, str(tmp_path / "bad.json")).collect()


def test_registry_and_store(spark):
    index = spark.createDataFrame([(0, "a", "fa", "n", ["u"]), (1, "b", "fb", "n", ["u"])], "pos int, id string, file string, name string, users array<string>")
    new = spark.createDataFrame([(0, " a", "fa", "n"), (1, "a", "fx", "n"), (2, "c", "fb", "n"), (3, "d", "fd", "n"), (4, " ", "f", "n")], "seq int, id string, file string, name string")
    assert sorted(r.outcome for r in template.register(index, new).collect()) == ["added", "file_conflict", "id_conflict", "invalid", "unchanged"]
    assert [r.id for r in template.appended(index, new).orderBy("pos").collect()] == ["a", "b", "d"]
    batch = [(0, "x", "f1", "n"), (1, "x", "f2", "n"), (2, "y", "f2", "n"), (3, "x", "f1", "n"), (4, "z", "f2", "n"), (5, "w", "f3", "n")]
    added = template.appended(index, spark.createDataFrame(batch, "seq int, id string, file string, name string")).orderBy("pos").collect()
    assert [(r.pos, r.id, r.file) for r in added][2:] == [(2, "x", "f1"), (3, "y", "f2"), (4, "w", "f3")]
    a = spark.createDataFrame([("1", "x", "y"), ("2", None, "y")], "id string, label string, value string")
    ch = spark.createDataFrame([("1", ["label"], None, "z")], "id string, set array<string>, label string, value string")
    assert {tuple(r) for r in store.patch(a, ch, ["label", "value"]).collect()} == {("1", None, "y"), ("2", None, "y")}
    assert sheet.column_names(30) == [f"part{i}" for i in range(1, 21)] and sheet.column_names(2, ["a", " "]) == ["a", "col2"]


def test_hints_and_ranges(spark):
    def hinted(text, **h):
        df = spark.createDataFrame([(text, h.get("score"), h.get("pm"), h.get("degree"))], "t string, diameter_score double, plus_minus boolean, degree boolean")
        return df.select(X.merge_symbol_hints(F.col("t"), F.struct("diameter_score", "plus_minus", "degree")).alias("o")).first().o

    assert hinted("(φ12", score=0.4) == "Ø12" and hinted(" 12.5 ", score=0.32) == "Ø12.5" and hinted("R5", score=0.9) == "R5" and hinted("12", score=0.3) == "12"
    assert hinted("Ø12.5 0.1", pm=True) == "Ø12.5 0.1" and hinted("12.5 0.1 ", pm=True) == "12.5±0.1" and hinted("12 9", pm=True) == "12 9" and hinted("12.5 0.1 +/-", pm=True) == "12.5 0.1 +/-"
    assert hinted("32′20'", degree=True) == "32°20'" and hinted("32 '", degree=True) == "32°" and hinted("32°5'", degree=True) == "32°5'" and hinted("  ", score=1.0) == ""
    texts = ["50±.05", "±x 7", "a", "1±2±3", "5±"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.o for r in df.select("i", X.derive_range(F.col("t")).alias("o")).orderBy("i").collect()] == ["+.05, -.05", "+7, -7", "", "+2, -2", ""]
    size = spark.createDataFrame([(10, 10), (10, 26), (0, 3), (26, 10)], "w int, h int").select(X.orientation_of_box(F.col("w"), F.col("h")).alias("o"))
    assert [r.o for r in size.collect()] == ["horizontal", "vertical", "vertical", "horizontal"]


def test_unicode_space_and_primes(spark):
    data = [("215.37\u00a0±\u00a00.05", "215.37±0.05"), ("\u200312.5″\u2003", '12.5"')]
    df = spark.createDataFrame(data, "t string, want string")
    assert all(r.o == r.want for r in df.select("want", X.fix_symbols(F.col("t")).alias("o")).collect())
    cad = spark.createDataFrame([("12.5″", "12.5"), ("215,370.05", "215.37±0.05"), ("215.370.05", "215.37±0.05"), ("17.5+0.25", "17.5±0.25"), ("215.37,05", "215.37±0.05"), ("FINISH A", "FINISH A")], "t string, want string")
    assert all(r.o == r.want for r in cad.select("want", X.normalize_cad_number(F.col("t")).alias("o")).collect())
