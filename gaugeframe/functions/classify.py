"""Types, scores and acceptance of dimension text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Fixed value: what a fragment of a number looks like.
PARTIAL = r"^\s*(?:[±+\-]?\d*[.,]?|\d+[.,]?|\d{1,2}[±+\-]?\d{0,2})$"
#: The first label suggested for a type.
LABELS = {
    "Diameter": "Outer Diameter", "Radius": "Corner Radius", "Angle": "Chamfer Angle", "Tolerance": "Dimensional Tolerance",
    "Linear": "Length", "Note": "General Note", "Unknown": "Dimension",
}


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def classify(t: Column) -> Column:
    s = strip(t)
    return (
        F.when(s.rlike("[Øø]"), "Diameter").when(s.rlike(r"\bR\d|^R[\d.]"), "Radius").when(s.rlike("[°'\"]") & s.rlike(r"\d"), "Angle")
        .when(s.contains("±"), "Tolerance").when(s.rlike(r"^\d"), "Linear").when(s != "", "Note").otherwise("Unknown")
    )


def compose_kind(t: Column) -> Column:
    """Lower-case kind of a composed text: angle before radius, diameter, tolerance; else linear, words too."""
    return (
        F.when(t.contains("°"), "angle").when(t.rlike("^R"), "radius").when(t.rlike("^Ø"), "diameter")
        .when(t.contains("±"), "tolerance").when(strip(t) != "", "linear").otherwise("unknown")
    )


def is_segment_worthy(t: Column) -> Column:
    s = strip(F.coalesce(t, F.lit("")))
    digits = count_of(s, r"\d")
    return (
        F.when(F.length(s) < 3, False).when(s.rlike("[°ØøφΦ]"), True).when(s.rlike("['\"′″]"), True)
        .when(s.rlike(r"±|\+/-"), digits >= 2).when(s.rlike(r"^[Rr]\d"), True).when(digits < 3, False)
        .when(s.rlike(PARTIAL), False).when(s.endswith(".") & (digits < 4), False).otherwise(True)
    )


def digit_quality(t: Column, confidence: Column) -> Column:
    s = strip(t)
    digits = count_of(s, r"\d")
    points = lambda pattern, n: F.when(s.rlike(pattern), float(n)).otherwise(0.0)
    score = (
        confidence * 15.0 + digits * 2.5 + points(r"\d+\.\d+", 8) + points(r"±|\+/-", 4) + points("[ØøφΦ]", 3) + points("±", 6)
        - points(r"\d,\d{3}", 12) - F.length(F.regexp_replace(s, r"[ØøRr±°'\".\d\s]", "")) * 4.0
        - F.when(digits < 2, 10.0).otherwise(0.0) - F.when(F.length(s) > 80, 5.0).otherwise(0.0)
    )
    return F.when(F.coalesce(s, F.lit("")) == "", 0.0).otherwise(score)


def count_symbols(t: Column) -> Column:
    return count_of(t, "[±°Ø'\"]")


def engineering_quality(t: Column, confidence: Column) -> Column:
    score = confidence * 10.0 + count_symbols(t) * 3.0 + count_of(t, r"\d") * 0.5
    return F.when(strip(t) == "", 0.0).otherwise(score)


def suggest_label(kind: Column, value: Column) -> Column:
    base = F.coalesce(*[F.when(kind == k, v) for k, v in LABELS.items()])
    return F.when((kind == "Diameter") & value.rlike("(?i)inner|bore"), "Inner Diameter").when((kind == "Radius") & value.rlike("(?i)fillet"), "Fillet Radius").otherwise(base)


def needs_review(t: Column, confidence: Column, agreement: Column, corrected: Column) -> Column:
    return (strip(F.coalesce(t, F.lit(""))) != "") & ((confidence < 0.9) | (agreement < 0.6) | corrected)


def has_phi_evidence(raw: Column, prefix: Column, diameter_score: Column) -> Column:
    mark = lambda c: F.coalesce(strip(c).rlike("^[ØøφΦ⌀]"), F.lit(False))
    return mark(raw) | mark(prefix) | F.coalesce(diameter_score >= 0.32, F.lit(False))


def prefix_reason(raw: Column, confidence: Column, reusable: Column, diameter_score: Column) -> Column:
    """Why a prefix is read again, or isn't.  Fixed values: the reasons."""
    s = strip(F.coalesce(raw, F.lit("")))
    return (
        F.when(s == "", "empty_main_result").when(reusable, "reused_main_or_visual_symbol").when(confidence <= 0.95, "main_confidence_not_above_95").when(s.rlike("^[O0Q©¢C]"), "ambiguous_leading_character")
        .when((diameter_score >= 0.20) & (diameter_score < 0.32), "borderline_phi_score").otherwise("high_confidence_main_result")
    )


def prefix_is_read(reason: Column) -> Column:
    return reason.isin("main_confidence_not_above_95", "ambiguous_leading_character", "borderline_phi_score")
