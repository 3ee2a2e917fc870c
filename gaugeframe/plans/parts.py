"""Queries of single functions and stages, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import ids, ranges
from ..functions import text as X
from ..operators import boxes as B
from ..operators import sheet, store, template, vote
from ..sources import files
from .queries import BB, COMPONENTS, INK, KEY, KEYS, SHEET, A, annotations, boxes, query, spec_sql, specs
from .views import duck, view

# Text.

#: Texts with typographic primes, loose blanks, and leading symbols in every form.
LOOSE = """CASE l_suppkey % 9 WHEN 0 THEN concat('12′', value, '″ ') WHEN 1 THEN concat('  φ ', value) WHEN 2 THEN concat('r', value) WHEN 3 THEN concat(value, ' +/- ', l_tax)
  WHEN 4 THEN 'FINISH  TURNED 5 mm' WHEN 5 THEN concat('R ', value, '  ±  2') WHEN 6 THEN '⌀ 12 , 5´ x' WHEN 7 THEN concat(' ⊕', value, '°  1') ELSE value END"""
_clean = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(t), '\+/[−-]', '±', 'g'), '^\s*[⊕∅⌀φΦø]', 'Ø'), '\s*([±°Ø''\x22])\s*', '\1', 'g'), '\s+', ' ', 'g'))"
_unspaced = r"array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN t[i] = ' ' AND NOT (regexp_matches(t[i - 1], '\p{L}') AND regexp_matches(t[i + 1], '\p{L}')) THEN '' ELSE t[i] END), '')"


@query(spec_sql(rf"""translate(t, '′’´″”ʺ', concat(repeat(chr(39), 3), repeat(chr(34), 3))) AS primes, {_unspaced} AS unspaced, {_clean} AS client,
  CASE WHEN regexp_matches(t, '^\s*[ØøφΦ⌀]') THEN 'Ø' WHEN regexp_matches(t, '^\s*[Rr]') THEN 'R' ELSE '' END AS symbol, regexp_replace(t, '^\s*[ØøφΦ⌀Rr]\s*', '') AS rest,
  regexp_matches(t, '^\s*[ØøφΦ⌀]') AS diameter, regexp_matches(t, '^\s*[Rr]\d') AS radius, contains(t, '±') OR contains(t, '+/-') AS plus_minus""", f"(SELECT *, {LOOSE} AS t FROM {duck('specs')})"))
def text_repairs(spark, sf_dir):
    t = F.expr(LOOSE)
    lead = X.leading_symbol(t)
    return specs(
        spark, sf_dir, primes=X.normalize_primes(t), unspaced=X.strip_dimension_spaces(t), client=X.fix_symbols_client(t), symbol=lead.symbol, rest=lead.rest,
        diameter=X.has_diameter_marker(t), radius=X.has_radius_marker(t), plus_minus=X.has_plus_minus(t),
    )


_misread = "translate(value, '015', 'OlS')"
_letters, _digits = "OoQDlIi|SsZzBgqG", "0000111155228996"
_digit = "{0} BETWEEN '0' AND '9'"


@query(spec_sql(
    "misread, fixed, fixed <> misread AS changed",
    f"""(SELECT *, list_reduce(list_concat([''], list_transform(range(1, length(misread) + 1), lambda i: misread[i:i + 1])), lambda a, p: a || CASE WHEN contains('{_letters}', p[1])
      AND ({_digit.format('a[-1]')} AND a <> '' OR {_digit.format('p[2]')} AND length(p) > 1) THEN translate(p[1], '{_letters}', '{_digits}') ELSE p[1] END) AS fixed FROM (SELECT *, {_misread} AS misread FROM {duck('specs')}))""",
))
def confusables(spark, sf_dir):
    """A nominal with zeros, ones and fives read as letters."""
    misread = F.translate(F.col("value"), "015", "OlS")
    fixed = X.correct_confusables(misread)
    return specs(spark, sf_dir, misread=misread, fixed=fixed.text, changed=fixed.changed)


HINTED = "CASE l_suppkey % 7 WHEN 0 THEN concat('(φ ', l_partkey) WHEN 1 THEN concat(l_partkey % 30, '.5 ', l_suppkey % 9, '.1') WHEN 2 THEN concat('32 ', chr(39), ' 5', chr(39)) WHEN 3 THEN concat('[ ', value) WHEN 4 THEN '12.5 0.1 +/-' ELSE concat(' ', value) END"
_score, _pm, _deg = "cast(l_partkey % 50 AS double) / 100", "l_partkey % 3 = 0", "l_partkey % 2 = 0"
_h1 = rf"""CASE WHEN {_score} >= 0.32 AND NOT starts_with(s, 'Ø') AND NOT starts_with(s, 'R') THEN CASE WHEN regexp_matches(s, '^[\s\[({{]*[φΦ⌀ø]') THEN regexp_replace(s, '^[\s\[({{]*[φΦ⌀ø]\s*', 'Ø') ELSE concat('Ø', s) END ELSE s END"""
_pair = r"^(\d+\.?\d*)\s+(\d+\.?\d*)\s*$"
_h2 = rf"""CASE WHEN {_pm} AND NOT contains(a, '±') AND NOT contains(a, '+/-') AND coalesce(n > 0 AND m > 0 AND n < m * 0.5 AND (n <= 2 OR n < m), false) THEN regexp_replace(a, '{_pair}', '\1±\2') ELSE a END"""
_num = lambda i: f"TRY_CAST(regexp_extract(a, '{_pair}', {i}) AS DOUBLE)"


@query(spec_sql(
    rf"CASE WHEN {_deg} AND NOT contains(b, '°') THEN regexp_replace(b, '(\d)\s*[''′]', '\1°') ELSE b END AS merged, coalesce(n > 0 AND m > 0 AND n < m * 0.5 AND (n <= 2 OR n < m), false) AS pair",
    f"(SELECT *, {_h2} AS b FROM (SELECT *, {_num(1)} AS m, {_num(2)} AS n FROM (SELECT *, {_h1} AS a FROM (SELECT *, trim({HINTED}) AS s FROM {duck('specs')}))))",
))
def symbol_hints(spark, sf_dir):
    d = view(spark, sf_dir, "specs").select(*KEY, F.expr(HINTED).alias("t"), F.struct(F.expr(_score).alias("diameter_score"), F.expr(_pm).alias("plus_minus"), F.expr(_deg).alias("degree")).alias("h"))
    none = F.struct(F.col("h.diameter_score"), F.lit(False).alias("plus_minus"), F.lit(False).alias("degree"))
    first = X.merge_symbol_hints(F.col("t"), none)
    pair = rf"^(\d+\.?\d*){X.JS_S}+(\d+\.?\d*){X.JS_S}*$"
    fits = X.is_tolerance_pair(F.regexp_extract(first, pair, 1), F.regexp_extract(first, pair, 2), need_point=False)
    return d.select(*KEY, X.merge_symbol_hints(F.col("t"), F.col("h")).alias("merged"), fits.alias("pair"))


#: Readings by number, and what the engine makes of each: composed text, kind and steps, by the definition.
READINGS = [
    # raw, prefix, score, degree, radius, vertical | text, kind, steps
    ("174.07", "Ø", 0.0, False, False, False, "Ø174.07", "diameter", ""),
    ("Ø174.07", "Ø", 0.0, False, False, False, "Ø174.07", "diameter", ""),
    ("215,370.05", "", 0.0, False, False, True, "Ø215.37±0.05", "diameter", "cad_digit_fix vertical_dia_tol"),
    ("215,370.05", "", 0.5, False, False, False, "Ø215.37±0.05", "diameter", "cad_digit_fix phi_prefix"),
    ("215.37±0.05", "", 0.0, False, False, False, "215.37±0.05", "tolerance", "explicit_pm"),
    ("12.5″", "", 0.0, False, False, False, "12.5", "linear", "cad_digit_fix"),
    ("12.5", "", 0.0, False, True, False, "R12.5", "radius", "radius"),
    ("r5", "", 0.0, False, False, False, "R5", "radius", ""),
    ("O174", "", 0.4, False, False, False, "Ø174", "diameter", "leading_o_phi"),
    ("O174", "", 0.1, False, False, False, "O174", "linear", ""),
    ("32\"20'40", "", 0.0, False, False, False, "32°20'40\"", "angle", "cad_digit_fix angle_dms"),
    ("32 20", "", 0.0, True, False, False, "3220", "linear", ""),
    ("45", "", 0.0, True, False, False, "45°", "angle", "angle_dms"),
    ("FINISH A", "", 0.0, False, False, False, "FINISH A", "linear", ""),
    ("  ", "", 0.9, False, False, False, "", "unknown", ""),
    ("50", "", 0.32, False, True, False, "Ø50", "diameter", "phi_prefix"),
    ("17.5+/-0.25", "", 0.0, False, False, False, "17.5±0.25", "tolerance", "explicit_pm"),
]
_sql = lambda v: "'" + v.replace("'", "''") + "'"


@query(f"""WITH r(k, text, kind, applied) AS (VALUES {', '.join(f"({i}, {_sql(r[6])}, {_sql(r[7])}, {_sql(r[8])})" for i, r in enumerate(READINGS))})
SELECT p_partkey, text, kind, applied FROM part JOIN r ON p_partkey % {len(READINGS)} = k""")
def composed_readings(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = ("raw", "prefix", "diameter_score", "degree", "radius", "vertical")
    cases = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r[:6], strict=True)]) for r in READINGS])
    d = vote.compose(d.select("p_partkey", F.get(cases, F.col("p_partkey") % len(READINGS)).alias("r")).select("p_partkey", "r.*"))
    return d.select("p_partkey", F.col("composed").alias("text"), "kind", F.array_join("applied", " ").alias("applied"))


NAMED = "CASE p_partkey % 5 WHEN 0 THEN concat(p_name, '.v1.png') WHEN 1 THEN concat(p_name, '.') WHEN 2 THEN '.png' WHEN 3 THEN concat('cw_', p_size) ELSE concat('07_', p_name, '.json') END"


@query(rf"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, '.v1') WHEN p_partkey % 5 = 2 THEN '' WHEN p_partkey % 5 = 4 THEN concat('07_', p_name) ELSE n END AS project,
  split_part(n, '_', 1) AS orientation, split_part(n, '_', 2) AS filter, CASE WHEN p_partkey % 5 = 4 THEN '07' ELSE '' END AS step, CASE WHEN p_partkey % 5 = 4 THEN p_name ELSE '' END AS step_name,
  concat_ws(' · ', nullif(p_type, ''), CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN concat('± ', p_size) END) AS detail,
  CASE WHEN p_size % 3 = 0 THEN concat(p_name, ' ', p_size) ELSE p_name END AS with_range,
  CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS STRING) ELSE CAST(x AS STRING) END AS json FROM (SELECT *, {NAMED} AS n, round(cast(p_size AS double) / 8, 6) AS x FROM part)""")
def names_and_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("n", F.expr(NAMED))
    some = lambda k, c: F.when(F.col("p_size") % k == 0, c).otherwise("")
    size = F.col("p_size").cast("string")
    v, step = ids.variant_parts(F.col("n")), ids.step_parts(F.col("n"))
    return d.select(
        "p_partkey", ids.without_extension(F.col("n")).alias("project"), v.orientation.alias("orientation"), v["filter"].alias("filter"), step.number.alias("step"), step["name"].alias("step_name"),
        X.detail_line(F.col("p_type"), some(2, F.col("p_brand")), some(3, size)).alias("detail"), X.value_with_range(F.col("p_name"), some(3, size)).alias("with_range"),
        ranges.json_number(F.col("p_size").cast("double") / 8).alias("json"),
    )


# Boxes.

_area = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
_ta, _ua = "greatest(a.w * a.h, 1)", "greatest(b.w * b.h, 1)"


@query(f"""SELECT a.page_id, a.box_id, {_area} > 0 AND {_area} / {_ta} >= 0.45 AND {_area} / {_ua} >= 0.08 AND NOT ({_ta} < 0.15 * {_ua} AND b.h > b.w * 1.3) AS plausible,
  b.x < a.x - 4 OR b.y < a.y - 4 OR b.x + b.w > a.x + a.w + 4 OR b.y + b.h > a.y + a.h + 4 AS outside,
  greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS union_w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS union_h,
  greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) / greatest(least(a.w, b.w), 1) AS columns_shared, round({_area} / least({_ta}, {_ua}), 9) AS shared,
  a.y AS turned_x, 400 - (a.x + a.w) AS turned_y, least(a.x, b.x) AS drawn_x, abs(b.y - a.y) AS drawn_h FROM {BB} AS a JOIN {BB} AS b ON a.page_id = b.page_id AND b.box_id = a.box_id + 1""")
def box_checks(spark, sf_dir):
    d = boxes(spark, sf_dir).select("page_id", "box_id", B.BOX().alias("a"))
    d = d.join(d.select("page_id", (F.col("box_id") - 1).alias("box_id"), F.col("a").alias("b")), ["page_id", "box_id"])
    a, b = F.col("a"), F.col("b")
    w, h = G.union_size(a, b)
    turned, drawn = G.unrotate_pass(a, F.lit(400.0)), G.box_of_points(a.x, a.y, b.x, b.y)
    return d.select(
        "page_id", "box_id", G.text_box_plausible(a, b).alias("plausible"), G.out_of_bounds(a, b, F.lit(5.0)).alias("outside"), w.alias("union_w"), h.alias("union_h"),
        G.perpendicular_overlap(a, b, F.lit("vertical")).alias("columns_shared"), F.round(G.overlap_fraction(a, b), 9).alias("shared"),
        turned.x.alias("turned_x"), turned.y.alias("turned_y"), drawn.x.alias("drawn_x"), drawn.h.alias("drawn_h"),
    )


_capped = " AND greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) <= 0.34 * 150 AND greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) <= 0.42 * 120"


@query("SELECT page_id, box_id, other_id FROM (" + COMPONENTS + "SELECT a.page_id, a.box_id, b.box_id AS other_id FROM p JOIN bx AS a USING (page_id, box_id) JOIN bx AS b ON b.page_id = p.page_id AND b.box_id = p.other_id WHERE true" + _capped + ")")
def box_pairs_capped(spark, sf_dir):
    """Pairs on pages of 150 x 120, whose caps many unions exceed."""
    return B.merge_pairs(boxes(spark, sf_dir), 0.72, 150.0, 120.0)


_over = f"SELECT a.page_id, a.box_id AS i, b.box_id AS j FROM {BB} AS a JOIN {BB} AS b ON a.page_id = b.page_id AND a.box_id <> b.box_id WHERE {_area} / least({_ta}, {_ua}) >= 0.1"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_over}), r(page_id, box_id, seen) AS (SELECT page_id, box_id, box_id FROM {BB} UNION SELECT r.page_id, r.box_id, e.j FROM r JOIN e ON r.page_id = e.page_id AND r.seen = e.i)
SELECT page_id, box_id AS cluster_id, min(seen) AS merged_id FROM r GROUP BY ALL""")
def overlapping_clusters(spark, sf_dir):
    return B.overlapping_clusters(boxes(spark, sf_dir).withColumnRenamed("box_id", "cluster_id"))


def greedy_sql(source: str, rank: str) -> str:
    """Of boxes in rank order those that share under half of the smaller with every one kept before."""
    part = "greatest(least(k.x + k.w, q.x + q.w) - greatest(k.x, q.x), 0) * greatest(least(k.y + k.h, q.y + q.h) - greatest(k.y, q.y), 0) / least(greatest(k.w * k.h, 1), greatest(q.w * q.h, 1))"
    return f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {rank}, box_id) AS n FROM {source}),
r(page_id, n, kept) AS (SELECT page_id, 1, [{{'box_id': box_id, 'x': x, 'y': y, 'w': w, 'h': h}}] FROM q WHERE n = 1
  UNION ALL SELECT r.page_id, r.n + 1, CASE WHEN len(list_filter(r.kept, lambda k: {part} >= 0.5)) > 0 THEN r.kept ELSE list_append(r.kept, {{'box_id': q.box_id, 'x': q.x, 'y': q.y, 'w': q.w, 'h': q.h}}) END
  FROM r JOIN q ON q.page_id = r.page_id AND q.n = r.n + 1)
SELECT page_id, unnest(kept).box_id AS box_id FROM (SELECT page_id, arg_max(kept, n) AS kept FROM r GROUP BY page_id)"""


_marks = "length(regexp_replace(t, '[^{0}]', '', 'g'))"


@query(greedy_sql(f"(SELECT *, concat(CASE WHEN box_id % 3 = 0 THEN 'Ø' ELSE '' END, box_id * page_id, '±', page_id) AS t, h / 100 AS conf FROM {BB})", f"-{_marks.format('ØøφΦ°±')}, -{_marks.format('0-9')}, -length(t), -conf"))
def nms_regions(spark, sf_dir):
    t = F.concat(F.when(F.col("box_id") % 3 == 0, "Ø").otherwise(""), (F.col("box_id") * F.col("page_id")).cast("string"), F.lit("±"), F.col("page_id").cast("string"))
    return B.dedupe_regions(boxes(spark, sf_dir).withColumns({"text": t, "conf": F.col("h") / 100})).select("page_id", "box_id")


@query(greedy_sql(f"(SELECT *, {INK} AS fill FROM {BB})", "-fill"))
def dedupe_boxes(spark, sf_dir):
    return B.dedupe_boxes(boxes(spark, sf_dir).withColumn("fill", F.expr(INK))).select("page_id", "box_id")


_up = f"(SELECT *, {INK} AS ink FROM {BB} WHERE box_id % 2 = 1)"
_turned = f"(SELECT page_id, box_id + coalesce((SELECT max(box_id) FROM {BB} AS m WHERE m.page_id = t.page_id AND m.box_id % 2 = 1), 0) AS box_id, y AS x, 400 - (x + w) AS y, h AS w, w AS h, {INK} AS ink FROM {BB} AS t WHERE box_id % 2 = 0)"
_cut = f"""(SELECT * FROM (SELECT *, ink / greatest(w * h, 1) AS fill FROM (SELECT page_id, box_id, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 600) - greatest(x, 0) AS w, least(y + h, 400) - greatest(y, 0) AS h, ink
  FROM (SELECT page_id, box_id, x, y, w, h, ink FROM {_up} UNION ALL SELECT * FROM {_turned})) WHERE w >= 1 AND h >= 1) WHERE fill >= 0.025)"""


@query(greedy_sql(_cut, "-fill"))
def box_proposals(spark, sf_dir):
    """Odd boxes from the upright pass, even ones from the turned pass."""
    d = boxes(spark, sf_dir).withColumn("ink", F.expr(INK))
    return B.proposals(d.where("box_id % 2 = 1"), d.where("box_id % 2 = 0"), 600.0, 400.0).select("page_id", "box_id")


#: Clusters' boxes, and the turns of sequential absorption: fragments by id, anchors as they have grown.
_gap = lambda q, r, k, n: f"greatest(0, {q}.{k} - {r}.{k} - {r}.{n}, {r}.{k} - {q}.{k} - {q}.{n})"
_side = lambda q, r, k, n: f"greatest(0, least({r}.{k} + {r}.{n}, {q}.{k} + {q}.{n}) - greatest({r}.{k}, {q}.{k})) / greatest(1, least({r}.{n}, {q}.{n}))"
_on = "CASE WHEN q.ax <> 's' THEN q.ax ELSE f.ax END"
_fits = f"(f.ax = q.ax OR f.ax = 's') AND ({_on}) <> 's' AND CASE WHEN ({_on}) = 'v' THEN {_side('q', 'f', 'x', 'w')} ELSE {_side('q', 'f', 'y', 'h')} END >= 0.35 AND CASE WHEN ({_on}) = 'v' THEN {_gap('q', 'f', 'y', 'h')} ELSE {_gap('q', 'f', 'x', 'w')} END <= 20"
_apart = f"CASE WHEN ({_on}) = 'v' THEN {_gap('q', 'f', 'y', 'h')} ELSE {_gap('q', 'f', 'x', 'w')} END"
_S = "STRUCT(id BIGINT, ax VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)"
_cluster = f"(SELECT page_id, box_id AS id, CASE WHEN h >= w * 1.35 THEN 'v' WHEN w >= h * 1.35 THEN 'h' ELSE 's' END AS ax, x, y, w, h FROM {BB})"


@query(f"""WITH RECURSIVE c AS MATERIALIZED {_cluster}, a0 AS (SELECT page_id, list(CAST({{'id': id, 'ax': ax, 'x': x, 'y': y, 'w': w, 'h': h}} AS {_S}) ORDER BY id) AS anchors FROM c WHERE w * h >= 650 GROUP BY page_id),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY id) AS n FROM c WHERE w * h < 650),
r(page_id, n, anchors, into_, of_) AS (SELECT page_id, 0, anchors, NULL::BIGINT, NULL::BIGINT FROM a0
  UNION ALL SELECT page_id, n, CASE WHEN best IS NULL THEN anchors ELSE list_transform(anchors, lambda q: CASE WHEN q.id = best THEN CAST({{'id': q.id, 'ax': q.ax, 'x': least(q.x, fx), 'y': least(q.y, fy), 'w': greatest(q.x + q.w, fx + fw) - least(q.x, fx), 'h': greatest(q.y + q.h, fy + fh) - least(q.y, fy)}} AS {_S}) ELSE q END) END, best, fid
  FROM (SELECT r.page_id, f.n, r.anchors, f.id AS fid, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh, list_sort(list_transform(list_filter(r.anchors, lambda q: {_fits}), lambda q: {{'gap': {_apart}, 'id': q.id}}))[1].id AS best
    FROM r JOIN f ON f.page_id = r.page_id AND f.n = r.n + 1))
SELECT c.page_id, c.id AS cluster_id, coalesce(r.into_, c.id) AS anchor_id FROM c LEFT JOIN r ON r.page_id = c.page_id AND r.of_ = c.id""")
def absorb_fragments(spark, sf_dir):
    d = boxes(spark, sf_dir).withColumn("cluster_id", F.col("box_id"))
    return B.absorb_fragments(B.bounds(d), B.first_axes(d))


# Readings of words.


@query(f"SELECT crop_id, string_agg(trim(text), '' ORDER BY y, seq) AS text FROM {duck('candidates')} GROUP BY crop_id")
def client_vertical(spark, sf_dir):
    return vote.assemble_lines(view(spark, sf_dir, "candidates"), "vertical")


@query(f"""WITH w AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY crop_id ORDER BY x + y, seq)) >= 15 AS jump FROM {duck('candidates')}),
l AS (SELECT *, sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY crop_id ORDER BY x + y, seq) AS line FROM w) SELECT crop_id, string_agg(text, ' ' ORDER BY line, x, seq) AS text FROM l GROUP BY crop_id""")
def client_rotated(spark, sf_dir):
    return vote.assemble_lines(view(spark, sf_dir, "candidates"), "rotated")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY length(regexp_replace(text, '[^±°Ø''\\x22]', '', 'g')) * 3 + conf * 10 + length(regexp_replace(text, '[^0-9]', '', 'g')) * 0.5 DESC, seq) AS n FROM
  (SELECT * EXCLUDE text, CASE WHEN seq % 2 = 0 THEN concat('Ø', text, '±0.1') ELSE text END AS text FROM {duck('candidates')})) SELECT crop_id, text, conf FROM c WHERE n = 1""")
def merged_candidates(spark, sf_dir):
    """The best candidate once its symbols are repaired."""
    loose = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" ø "), "text", F.lit(" +/- 0.1"))).otherwise(F.col("text"))
    d = view(spark, sf_dir, "candidates").withColumn("text", X.fix_symbols(loose))
    return vote.pick_best(d, C.engineering_quality)


# Sources.

RESULTS = """CASE crop_id % 6 WHEN 0 THEN concat('{"res":{"res":{"rec_texts":["', text, '"," "],"rec_scores":[', conf, '],"dt_polys":[[', x, ',', y, ',', x + w, ',', y + h, ']]}}}')
  WHEN 1 THEN concat('[[[[[', x, ',', y, '],[', x + w, ',', y, '],[', x + w, ',', y + h, ']],["', text, '",', conf, ']]]]')
  WHEN 2 THEN concat('[["', text, '",', conf, '],[[', x, ',', y, ',', x + w, ',', y + h, '],"', text, '",', conf, ']]')
  WHEN 3 THEN concat('{"rec_text":"', text, '","rec_score":', conf, '}') WHEN 4 THEN concat('[[[[', x, ',', y, ']],{"rec_text":"', text, '","confidence":', conf, '}],null,7]') ELSE concat('["', text) END"""
_boxed = "(crop_id % 6 < 2 OR crop_id % 6 = 2 AND k = 1)"


@query(f"""SELECT crop_id, seq, k, text, CASE WHEN {_boxed} OR crop_id % 6 = 4 THEN x ELSE 0 END AS x, CASE WHEN {_boxed} OR crop_id % 6 = 4 THEN y ELSE 0 END AS y, CASE WHEN {_boxed} THEN w ELSE 0 END AS width, CASE WHEN {_boxed} THEN h ELSE 0 END AS height, conf AS confidence
  FROM {duck('candidates')}, (SELECT unnest([0, 1]) AS k) WHERE crop_id % 6 <> 5 AND (k = 0 OR crop_id % 6 = 2)""")
def recognised_lines(spark, sf_dir):
    """Every shape of a recogniser's result: pages inside res, nested lists, boxes of four numbers, dicts, and no JSON."""
    d = view(spark, sf_dir, "candidates")
    raw = d.select(F.struct("crop_id", "seq").alias("crop_id"), F.expr(RESULTS).alias("value"))
    raw = raw.select(F.concat_ws("/", "crop_id.crop_id", "crop_id.seq").alias("crop_id"), "value")
    lines = files.ocr_lines(raw)
    part = F.split("crop_id", "/")
    return lines.select(part[0].cast("long").alias("crop_id"), part[1].cast("long").alias("seq"), F.col("seq").alias("k"), "text", "x", "y", "width", "height", "confidence")


BUNDLE = """CASE p_partkey % 7 WHEN 0 THEN '{not' WHEN 1 THEN '{"format":"other"}' WHEN 2 THEN '{"format":"project","source":{"fileType":"image"}}' WHEN 3 THEN '{"format":"project","source":{"dataUrl":"data:,","fileType":""}}'
  WHEN 4 THEN '{"format":"project","source":{"dataUrl":"data:,","fileType":"image"}}' WHEN 5 THEN concat('{"format":"project","projectName":"', p_name, '","source":{"dataUrl":"data:image/png;base64,QUJD","fileType":"image"},"annotations":[{"id":"a"},{"id":"b"}]}') ELSE '[]' END"""


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not a project file' WHEN 2 THEN 'no source data' WHEN 3 THEN 'no file type' WHEN 4 THEN 'no annotations list' WHEN 6 THEN 'not a project file' END AS error,
  CASE WHEN p_partkey % 7 = 5 THEN p_name END AS name, CASE WHEN p_partkey % 7 = 5 THEN 2 END AS annotations, CASE WHEN p_partkey % 7 = 5 THEN 'ABC' WHEN p_partkey % 7 IN (3, 4) THEN '' END AS data FROM part""")
def parsed_bundles(spark, sf_dir):
    d = files.parse_bundles(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(BUNDLE).alias("value")))
    data = files.data_url_bytes(F.col("b.source.dataUrl")).cast("string")
    return d.select("p_partkey", "error", F.col("b.projectName").alias("name"), F.when(F.col("b.annotations").isNotNull(), F.size("b.annotations")).alias("annotations"), data.alias("data"))


INDEX = """CASE p_partkey % 5 WHEN 0 THEN '[{"id"' WHEN 1 THEN '{"id":"a"}' WHEN 2 THEN '[{"id":"a"}, 3]' WHEN 3 THEN '[]' ELSE concat(' [{"id":"', p_name, '","file":"f"}]') END"""


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not a JSON array' WHEN 2 THEN 'an entry is not a JSON object' END AS error, CASE WHEN p_partkey % 5 = 3 THEN 0 WHEN p_partkey % 5 = 4 THEN 1 END AS entries,
  CASE p_partkey % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN NULL ELSE 'not a JSON object' END AS object_error, CASE WHEN p_partkey % 5 = 1 THEN 'a' END AS id FROM part""")
def parsed_index(spark, sf_dir):
    d = files.parse_index(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(INDEX).alias("value")))
    n = F.when(F.col("error").isNull(), F.size("entries"))
    d = files.parse_objects(d.select("p_partkey", "value", F.col("error").alias("e"), n.alias("entries")))
    return d.select("p_partkey", F.col("e").alias("error"), "entries", F.col("error").alias("object_error"), F.element_at("object", "id").alias("id"))


# The store.


def _some(a):
    """A few columns of annotations."""
    return a.select("id", "number", "kind", "label", "value", "type", "label_id", "range", "method", "tool")


_cols = "id, number, kind, label, value, type, label_id, range, method, tool"


@query(f"SELECT {_cols} FROM {A} WHERE project_id = 'P2' AND page = 2")
def project_page(spark, sf_dir):
    return _some(store.on_page(store.load(annotations(spark, sf_dir), "P2"), 2))


@query(f"SELECT {_cols} FROM {A} WHERE project_id <> 'P4' AND NOT (id LIKE 'L%5')")
def deleted(spark, sf_dir):
    """One project gone with its annotations, and labels whose id ends in 5 without theirs."""
    a = annotations(spark, sf_dir)
    _, left = store.delete_project(a.select(F.col("project_id").alias("id")).distinct(), a, "P4")
    return _some(store.remove(left, left.where("id like 'L%5'").select("id")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS name FROM part UNION ALL SELECT -s_suppkey, 'new' FROM supplier")
def saved_projects(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((-F.col("s_suppkey")).cast("long").alias("id"), F.lit("new").alias("name"))
    return store.upsert(p, p.where("id % 3 = 0").withColumn("name", F.lit("new")).unionByName(s))


@query(f"""SELECT id, CASE WHEN number % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN number % 3 = 0 THEN 'x' ELSE tool END AS tool, method FROM {A}""")
def patched(spark, sf_dir):
    a = annotations(spark, sf_dir)
    c = a.where("number % 3 = 0").select("id", F.array(F.lit("value"), F.lit("tool")).alias("set"), F.lit(None).cast("string").alias("value"), F.lit("x").alias("tool"), F.lit("y").alias("method"))
    return store.patch(a, c, ["value", "tool", "method"]).select("id", "value", "tool", "method")


_edit = "coalesce(a.kind, 'dimension') = 'dimension' AND a.number % 5 = 0"


@query(f"""WITH up AS (SELECT label_id AS id, max('L' || number) AS v FROM {A} AS a WHERE {_edit} AND number % 2 = 0 AND label_id IS NOT NULL GROUP BY 1)
SELECT a.id, CASE WHEN {_edit} AND a.number % 2 = 0 THEN 'L' || a.number ELSE a.label END AS label, CASE WHEN up.id IS NOT NULL THEN up.v WHEN {_edit} AND a.number % 2 = 1 THEN 'R' || a.number ELSE a.value END AS value,
  CASE WHEN {_edit} AND a.number % 2 = 1 THEN 'Radius' ELSE a.type END AS type, CASE WHEN a.number % 7 = 0 THEN 'new' ELSE '' END AS part1, CASE WHEN a.number % 7 = 0 THEN '9' END AS part2
FROM {A} AS a LEFT JOIN up ON up.id = a.id""")
def edited_cells(spark, sf_dir):
    """Labels and values written in the checksheet page, and its extra columns."""
    a = annotations(spark, sf_dir)
    dims = a.where("coalesce(kind, 'dimension') = 'dimension' and number % 5 = 0")
    even, n = F.col("number") % 2 == 0, F.col("number").cast("string")
    edits = dims.select("id", "label_id", F.when(even, "label").otherwise("value").alias("field"), F.concat(F.when(even, "L").otherwise("R"), n).alias("value"))
    extras = a.where("number % 7 = 0").select("id", F.create_map(F.lit("part1"), F.lit("new"), F.lit("part2"), F.lit("9")).alias("extras"))
    out = store.set_extras(store.set_fields(a, edits), extras)
    return out.select("id", "label", "value", "type", F.element_at("extras", "part1").alias("part1"), F.element_at("extras", "part2").alias("part2"))


@query(f"SELECT id FROM {A} WHERE id = 'L7' OR label_id = 'L7' UNION SELECT id FROM {A} WHERE id IN (SELECT label_id FROM {A} WHERE id = 'L7')")
def related_ids(spark, sf_dir):
    return store.related(annotations(spark, sf_dir), "L7")


_TYPE = r"CASE WHEN regexp_matches(value, '[Øø]') THEN 'Diameter' WHEN regexp_matches(value, '\bR\d|^R[\d.]') THEN 'Radius' WHEN regexp_matches(value, '[°''\x22]') AND regexp_matches(value, '\d') THEN 'Angle' WHEN contains(value, '±') THEN 'Tolerance' WHEN regexp_matches(value, '^\d') THEN 'Linear' ELSE 'Note' END"


@query(f"""SELECT {KEYS}, type, CASE type WHEN 'Diameter' THEN 'Outer Diameter' WHEN 'Radius' THEN 'Corner Radius' WHEN 'Angle' THEN 'Chamfer Angle' WHEN 'Linear' THEN 'Length' WHEN 'Tolerance' THEN 'Dimensional Tolerance' ELSE 'General Note' END AS label, value, 'dimension' AS kind
  FROM (SELECT {KEYS}, value, {_TYPE} AS type FROM {duck('specs')} WHERE l_suppkey % 4 <> 0)""")
def region_annotations(spark, sf_dir):
    d = view(spark, sf_dir, "specs").select(*KEY, F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.col("value")).alias("text"))
    return store.from_regions(d).select(*KEY, "type", "label", "value", "kind")


@query(f"""SELECT p.project_id, p.name, a.id FROM (SELECT 'P1' AS project_id, 'plan.v2' AS name UNION ALL SELECT 'none', 'Drawing') AS p LEFT JOIN {A} AS a USING (project_id)""")
def fetched(spark, sf_dir):
    wanted = spark.createDataFrame([("P1",), ("none",)], "project_id string")
    known = spark.createDataFrame([("P1", "plan.v2.pdf"), ("P2", "b.png")], "id string, name string")
    return store.fetch(wanted, known, annotations(spark, sf_dir)).select("project_id", "name", "id")


# Ways out.

_json = ", ',', ".join(f"""'"{k}":', CAST(to_json("{k}") AS STRING)""" for k in ("7", "S.no", "Label", "Value", "Tolerance", "part1", "Method", "Tool"))


@query(f"""SELECT project_id, concat('{{"data":[', string_agg(line, ',' ORDER BY number, line), '],"extra_columns":["part1","7"]}}') AS json
  FROM (SELECT project_id, number, concat('{{', {_json}, '}}') AS line FROM (SELECT *, '' AS "7" FROM ({SHEET.replace("SELECT number,", "SELECT project_id, number,")}))) GROUP BY project_id""")
def inspection_json(spark, sf_dir):
    """A column that is a whole number comes first in its object."""
    return sheet.inspection_json(sheet.inspection_sheet(annotations(spark, sf_dir), ["part1", "7"], keep=["project_id"]), ["part1", "7"])


_field = lambda c: f"coalesce(',\"{c}\":' || CAST(to_json({c}) AS STRING), '')"


@query(f"""SELECT project_id, concat('{{"format":"project","version":1,"projectName":"', project_id, '","savedAt":0,"source":{{"fileName":"d.png","mimeType":"image/png","fileType":"image","dataUrl":"data:,"}},"annotations":[', string_agg(a, ',' ORDER BY number, id), ']}}') AS json
  FROM (SELECT project_id, number, id, concat('{{"number":', number, {_field('id')}, {_field('kind')}, {_field('label')}, {_field('value')}, '}}') AS a FROM {A}) GROUP BY project_id""")
def project_bundles(spark, sf_dir):
    a = annotations(spark, sf_dir).select("project_id", "number", "id", "kind", "label", "value")
    source = F.struct(F.lit("d.png").alias("fileName"), F.lit("image/png").alias("mimeType"), F.lit("image").alias("fileType"), F.lit("data:,").alias("dataUrl"))
    projects = a.select("project_id").distinct().select("project_id", F.col("project_id").alias("project_name"), F.lit(0).cast("long").alias("saved_at"), source.alias("source"))
    return files.bundles(projects, a, "project")


@query(f"""SELECT id, CASE WHEN number % 3 = 0 THEN '' ELSE value END AS text, coalesce(label, '') AS label, CASE WHEN number % 2 = 0 THEN 'Unknown' ELSE type END AS type, x, w FROM {A}""")
def training_labels(spark, sf_dir):
    """Keys that are missing take a default."""
    a = annotations(spark, sf_dir)
    cells = F.map_from_arrays(F.array(F.lit("label"), F.lit("text")), F.array(F.coalesce("label", F.lit("")), F.lit("not this")))
    cells = F.map_concat(cells, F.when(F.col("number") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("value"), F.col("value"))))
    cells = F.map_concat(cells, F.when(F.col("number") % 2 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("type"), F.col("type"))))
    return sheet.training_labels(a.select("id", cells.alias("cells"), F.struct("x", "w").alias("bbox"))).select("id", "text", "label", "type", "bbox.*")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN '' WHEN 2 THEN 'c' ELSE 'b' END AS serial, concat('{"en":', to_json(p_name || chr(34)), ',"hi":', to_json(p_name || chr(34)), '}') AS label FROM part""")
def serials_and_labels(spark, sf_dir):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv]).cast("map<string,string>")
    k = F.col("p_partkey") % 4
    cells = F.when(k == 0, m("S.no", "a", "S.No", "b", "sno", "c")).when(k == 1, m("S.no", None, "sno", "c")).when(k == 2, m("sno", "c")).otherwise(m("S.No", "b", "sno", "c"))
    d = spark.read.parquet(f"{sf_dir}/part.parquet")
    return d.select("p_partkey", template.serial(cells).alias("serial"), template.both_languages(F.concat("p_name", F.lit('"'))).alias("label"))
