"""Voting over candidate readings of a crop: candidates(crop_id, seq, text, conf)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import text as X

EARLY = 0.95


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates with text, with normalised text, score and corrected."""
    fixed = X.correct_confusables(F.col("text"))
    d = candidates.where(X.strip(F.coalesce("text", F.lit(""))) != "").withColumn("fixed", fixed)
    d = d.withColumn("normalized", X.normalize_cad_number(F.col("fixed.text"))).withColumn("corrected", F.col("fixed.changed")).drop("fixed")
    return d.withColumn("score", C.digit_quality(F.col("normalized"), F.col("conf")))


def vote(candidates: DataFrame) -> DataFrame:
    """crop_id, text, confidence, agreement, corrected: the text of the largest total score, the one
    seen first on ties.  The first candidate surer than 0.95 ends the reading and wins outright."""
    d = scored(candidates)
    early = d.where((F.col("conf") > EARLY) & (X.strip(F.col("normalized")) != "")).groupBy("crop_id").agg(F.min_by(F.struct("normalized", "conf", "corrected"), "seq").alias("e"))
    groups = d.groupBy("crop_id", "normalized").agg(
        F.sum("score").alias("total"), F.count("*").alias("n"), F.max("conf").alias("best"), F.bool_or("corrected").alias("corrected"), F.min("seq").alias("first")
    )
    won = groups.groupBy("crop_id").agg(
        F.max_by(F.struct("normalized", "best", "corrected", "n"), F.struct("total", -F.col("first"))).alias("w"), F.sum("n").alias("all")
    )
    out = won.join(early, "crop_id", "left")
    pick = lambda a, b: F.when(F.col("e").isNotNull(), a).otherwise(b)
    return out.select(
        "crop_id",
        pick(F.col("e.normalized"), F.col("w.normalized")).alias("text"),
        pick(F.col("e.conf"), F.col("w.best")).alias("confidence"),
        pick(F.lit(1.0), F.round(F.col("w.n") / F.col("all"), 3)).alias("agreement"),
        pick(F.col("e.corrected"), F.col("w.corrected")).alias("corrected"),
    )


def reading_order(words: DataFrame, vertical: str = "vertical") -> DataFrame:
    """words(crop_id, seq, x, y, vertical, …) with ``place``: by bands of 15 pixels, then x; vertical text by y."""
    w = Window.partitionBy("crop_id").orderBy(F.when(F.col(vertical), F.col("y")).otherwise(F.rint(F.col("y") / 15.0)), F.when(F.col(vertical), 0.0).otherwise(F.col("x")), "seq")
    return words.withColumn("place", F.row_number().over(w))


def assemble(words: DataFrame) -> DataFrame:
    """crop_id, text, confidence, vertical of words(crop_id, seq, text, x, y, w, h, conf)."""
    size = words.groupBy("crop_id").agg((F.avg("h") > 2.5 * F.avg("w")).alias("vertical"))
    placed = reading_order(words.join(size, "crop_id"))
    out = placed.groupBy("crop_id", "vertical").agg(F.avg("conf").alias("confidence"), F.transform(F.sort_array(F.collect_list(F.struct("place", X.strip(F.col("text")).alias("text")))), lambda s: s.text).alias("parts"))
    joined = F.when(F.col("vertical"), F.array_join("parts", "")).otherwise(F.array_join("parts", " "))
    return out.select("crop_id", X.fix_symbols(joined).alias("text"), "confidence", "vertical")


def pick_best(candidates: DataFrame, score) -> DataFrame:
    """The candidate of the best score a crop, the first one on ties; ``score`` maps (text, conf) Columns."""
    s = score(F.col("text"), F.col("conf"))
    return candidates.groupBy("crop_id").agg(F.max_by(F.struct("text", "conf"), F.struct(s, -F.col("seq"))).alias("b")).select("crop_id", "b.*")


def merge_symbol_scores(symbols: DataFrame) -> DataFrame:
    """One row a crop: the best score, and what any of the looks saw."""
    d = symbols.groupBy("crop_id").agg(F.max("diameter_score").alias("diameter_score"), *[F.bool_or(c).alias(c) for c in ("plus_minus", "degree", "radius")])
    return d.withColumn("diameter", F.col("diameter_score") >= 0.32)


def timings(passes: DataFrame) -> DataFrame:
    return passes.groupBy("crop_id").agg(F.sum("elapsed").alias("paddle_total"), F.count("*").alias("paddle_pass_count"), F.sort_array(F.collect_list(F.struct("seq", "elapsed"))).alias("paddle_passes"))


def compose(readings: DataFrame) -> DataFrame:
    """readings(raw, prefix, diameter_score, degree, radius, vertical, …) with composed, kind, applied."""
    c, lit = F.col, F.lit
    raw, prefix = F.coalesce("raw", lit("")), F.coalesce("prefix", lit(""))
    d = readings.withColumn("_p", X.strip(prefix)).withColumn("_r", X.strip(raw))
    lead = (F.length("_p") <= 3) & c("_p").rlike("^[ØøφΦ⌀Rr]") & ~c("_r").startswith(F.substring("_p", 1, 1))
    d = d.withColumn("_t", F.when(lead & (c("_p") != ""), F.concat("_p", "_r")).otherwise(c("_r")))
    d = d.withColumn("_n", X.normalize_cad_number(c("_t")))
    blankless = lambda x: F.replace(x, lit(" "), lit(""))
    d = d.withColumn("_a1", blankless(c("_n")) != blankless(c("_t"))).withColumn("_t", X.fix_symbols(c("_n")))
    evidence = F.coalesce("degree", lit(False)) | X.has_angle_marks(raw) | X.has_angle_marks(prefix) | c("_t").contains("°")
    d = d.withColumn("_angle", X.parse_dms(c("_t"), ~evidence))
    d = d.withColumn("_ls", X.leading_symbol(c("_t"))).withColumn("_t", F.concat("_ls.symbol", "_ls.rest"))
    d = d.withColumn("_phi", C.has_phi_evidence(raw, prefix, c("diameter_score")))
    o = ~c("_t").rlike("^[ØR]") & c("_t").rlike(r"^[O0]\d{2,}") & c("_phi")
    d = d.withColumn("_a2", o).withColumn("_t", F.when(o, F.concat(lit("Ø"), F.substr("_t", lit(2)))).otherwise(c("_t")))
    d = d.withColumn("_a3", X.has_plus_minus(raw)).withColumn("_t", F.when(c("_a3"), F.replace("_t", lit("+/-"), lit("±"))).otherwise(c("_t")))
    pair = r"^(\d+\.\d{2})±(\d\.\d{2})$"
    bare, fits = ~c("_t").rlike("^[ØR]"), c("_t").rlike(pair)
    nominal, tol = F.regexp_extract("_t", pair, 1), F.regexp_extract("_t", pair, 2)
    tall = F.coalesce("vertical", lit(False)) & X.is_tolerance_pair(nominal, tol) & (nominal.try_cast("double") >= 1) & (tol.try_cast("double") <= 1)
    d = d.withColumn("_a4", bare & fits & F.coalesce(tall, lit(False)))
    d = d.withColumn("_a5", ~c("_a4") & bare & c("_phi") & c("_t").rlike(r"^\d"))
    d = d.withColumn("_t", F.when(c("_a4") | c("_a5"), F.concat(lit("Ø"), "_t")).otherwise(c("_t")))
    d = d.withColumn("_a6", F.coalesce("radius", lit(False)) & c("_t").rlike(r"^\d"))
    d = d.withColumn("_t", X.fix_symbols(F.when(c("_a6"), F.concat(lit("R"), "_t")).otherwise(c("_t"))))
    blank, angle = (c("_p") == "") & (c("_r") == ""), c("_angle").isNotNull()
    steps = lambda *names: F.array_compact(F.array(*[F.when(c(k), lit(v)) for k, v in names]))
    early = steps(("_a1", "cad_digit_fix"))
    full = steps(("_a1", "cad_digit_fix"), ("_a2", "leading_o_phi"), ("_a3", "explicit_pm"), ("_a4", "vertical_dia_tol"), ("_a5", "phi_prefix"), ("_a6", "radius"))
    return d.withColumns({
        "composed": F.when(blank, "").when(angle, c("_angle")).otherwise(c("_t")),
        "kind": F.when(blank, "unknown").when(angle, "angle").otherwise(C.compose_kind(c("_t"))),
        "applied": F.when(blank, F.array().cast("array<string>")).when(angle, F.array_append(early, lit("angle_dms"))).otherwise(full),
    }).drop("_p", "_r", "_t", "_n", "_angle", "_ls", "_phi", *[f"_a{i}" for i in range(1, 7)])


def assemble_lines(words: DataFrame, orientation: str = "horizontal", line: float = 15.0) -> DataFrame:
    """crop_id, text of words(crop_id, seq, text, x, y), client-side.  Vertical words stand by y and are
    joined without blanks; rotated ones by x + y, others by y: a new line where y jumps by ``line`` or
    more, and a line's words by x."""
    clean = lambda c: X.js_strip(F.regexp_replace(c, f"{X.JS_S}+", " "))
    if orientation == "vertical":
        parts = F.transform(F.sort_array(F.collect_list(F.struct("y", "seq", X.js_strip(F.col("text")).alias("text")))), lambda s: s.text)
        return words.groupBy("crop_id").agg(F.array_join(parts, "").alias("text"))
    w = Window.partitionBy("crop_id").orderBy(F.col("x") + F.col("y") if orientation == "rotated" else F.col("y"), "seq")
    jump = F.abs(F.col("y") - F.lag("y").over(w)) >= line
    d = words.withColumn("line", F.sum(F.when(jump, 1).otherwise(0)).over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", "x", "seq", "text"))), lambda s: s.text)
    return d.groupBy("crop_id").agg(clean(F.array_join(parts, " ")).alias("text"))


def winners_words(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """words(crop_id, seq, …), of every candidate, of the one that won: the first surer than 0.95, else of
    the winning text's candidates the surest, the first on ties."""
    d = scored(candidates)
    won = vote(candidates).select("crop_id", F.col("text").alias("_won"))
    mine = d.join(won, "crop_id").where(F.col("normalized") == F.col("_won"))
    early = d.where((F.col("conf") > EARLY) & (X.strip(F.col("normalized")) != "")).groupBy("crop_id").agg(F.min("seq").alias("_early"))
    best = mine.groupBy("crop_id").agg(F.max_by("seq", F.struct("conf", -F.col("seq"))).alias("_best"))
    pick = best.join(early, "crop_id", "left").select("crop_id", F.coalesce("_early", "_best").alias("seq"))
    return words.join(pick, ["crop_id", "seq"], "left_semi")


def recognise(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Typed values of crops: candidates(crop_id, seq, text, conf) are voted over, symbols(crop_id, prefix,
    diameter_score, plus_minus, degree, radius, vertical), one row a crop at most, complete the winner.
    ``prefix`` counts only where the reading asks for a second look."""
    no = F.lit(False)
    d = vote(candidates).withColumnRenamed("text", "raw").join(symbols, "crop_id", "left")
    seen = {c: F.coalesce(c, no) for c in ("plus_minus", "degree", "radius", "vertical")}
    d = d.withColumns(seen | {"diameter_score": F.coalesce("diameter_score", F.lit(0.0))})
    hints = (F.col("diameter_score") >= 0.32) | F.col("plus_minus") | F.col("degree") | F.col("radius")
    d = d.withColumn("prefix_reason", C.prefix_reason(F.col("raw"), F.col("confidence"), hints, F.col("diameter_score")))
    d = d.withColumn("prefix_used", C.prefix_is_read(F.col("prefix_reason")))
    late = X.symbols_of_prefix(F.col("prefix"))
    d = d.withColumn("late", F.when(F.col("prefix_used") & F.col("prefix").isNotNull(), late))
    d = d.withColumns({c: F.col(c) | F.coalesce(F.col(f"late.{c}"), no) for c in ("plus_minus", "degree", "radius")})
    d = d.withColumn("diameter_score", F.greatest("diameter_score", F.coalesce("late.diameter_score", F.lit(0.0))))
    d = compose(d.withColumn("prefix", F.when(F.col("prefix_used"), F.col("prefix"))))
    review = C.needs_review(F.col("composed"), F.col("confidence"), F.col("agreement"), F.col("corrected"))
    return d.select("crop_id", F.col("composed").alias("text"), "kind", "applied", "confidence", "agreement", "corrected", "prefix_used", "prefix_reason", review.alias("needs_review"))


def text_boxes(words: DataFrame, pictures: DataFrame) -> DataFrame:
    """(crop_id, x, y, w, h): words(crop_id, x, y, w, h) in pixels of the crop as received;
    pictures(crop_id, image, prep, oriented: struct<w, h>, vertical)."""
    u = words.groupBy("crop_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    union = G.box(F.col("x"), F.col("y"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))
    d = u.join(pictures, "crop_id").select("crop_id", G.text_box(union, F.col("image"), F.col("prep"), F.col("oriented"), F.col("vertical")).alias("b"))
    return d.where("b is not null").select("crop_id", "b.*")


def read_crops(pictures: DataFrame, provider) -> DataFrame:
    """candidates(crop_id, seq, text, conf, x, y, w, h) by a recogniser: ``provider()`` is made once a task
    and returns a function from a picture's bytes to its lines (text, conf, x, y, w, h)."""

    def run(batches):
        import pyarrow as pa

        read = provider()
        for b in batches:
            at, lines = [], []
            for i, data in enumerate(b.column(1).to_pylist()):
                found = list(read(data)) if data is not None else []
                at += [i] * len(found)
                lines += [(k, *line) for k, line in enumerate(found)]
            kinds = [pa.int64(), pa.string(), *[pa.float64()] * 5]
            cols = [pa.array([line[k] for line in lines], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=["crop_id", "seq", "text", "conf", "x", "y", "w", "h"])

    d = pictures.select("crop_id", "data")
    return d.mapInArrow(run, f"crop_id {d.schema['crop_id'].dataType.simpleString()}, seq long, text string, conf double, x double, y double, w double, h double")
