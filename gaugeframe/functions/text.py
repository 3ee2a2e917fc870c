"""Repair and parsing of recognised dimension text.  Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic primes and what they stand for.
PRIMES = {"′": "'", "’": "'", "´": "'", "″": '"', "”": '"', "ʺ": '"'}
#: Letters that are misread digits.
CONFUSABLES = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "S": "5", "s": "5", "Z": "2", "z": "2", "B": "8", "g": "9", "q": "9", "G": "6"}
#: Patterns of degrees, minutes and seconds, and of misread decimals.
DEGREE = "[°˚⁰]"
DECIMAL_DEGREES = rf"^\s*(\d{{1,3}}(?:\.\d+)?)\s*{DEGREE}\s*$"
DMS = rf"^\s*(\d{{1,3}})\s*{DEGREE}?\s*(?:(\d{{1,2}})\s*'\s*(?:(\d{{1,2}}(?:\.\d+)?)\s*\"?)?)?\s*$"
#: What an angle, and a number with a misread tolerance, can't be without.
ANGLE_SIGNS = "[°˚⁰'\"′’´″”ʺ]"
MISREAD = r"^\d+[.,]\d+[.,+]\d"
COMMA_DECIMAL = r"^(\d{2,}),(\d{2})[,.](\d{2})$"
COMMA_TOLERANCE = r"^(\d{2,}),(\d{2})(\d)\.(\d{2})$"
GLUED_TOLERANCE = r"^(\d+\.\d{1,4})(\d)\.(\d{1,4})$"
PLUS_TOLERANCE = r"^(\d+\.\d+)\+(\d+\.\d+)$"
SPLIT_TOLERANCE = r"^(\d+\.\d+)[,.](\d{1,2})(?:\.(\d{1,4}))?$"
PHI = "[ØøφΦ⌀]"
#: White space as Python has it, and as JavaScript has it.
_COMMON_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE, JS_SPACE = _COMMON_SPACE + "\x1c\x1d\x1e\x1f\x85", _COMMON_SPACE + "\ufeff"
#: Patterns of one such character: Java's own class knows ASCII only.
S, JS_S = f"[{SPACE}]", f"[{JS_SPACE}]"


def strip(t: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.trim(t, F.lit(SPACE))


def js_strip(t: Column) -> Column:
    """What trim() does in the client."""
    return F.trim(t, F.lit(JS_SPACE))


def group(t: Column, pattern: str, i: int = 1) -> Column:
    """The group, or null where the pattern isn't found or the group is empty."""
    return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_primes(t: Column) -> Column:
    return F.translate(t, "".join(PRIMES), "".join(PRIMES.values()))


def java(pattern: str) -> str:
    """The pattern with white space as Python has it."""
    return pattern.replace(r"\s", S)


def recover_degree_quote(t: Column) -> Column:
    """A double quote in the degrees' place of degrees and minutes is a degree sign."""
    return F.regexp_replace(t, java(r"""^(\s*\d{1,3})"(?=\s*\d{1,2}\s*')"""), "$1°")


def has_angle_marks(t: Column) -> Column:
    return normalize_primes(t).rlike(java(rf"""{DEGREE}|\d\s*['"]"""))


def parse_dms(t: Column, require_marks: bool | Column = True) -> Column:
    """Canonical degrees, minutes, seconds; null if it isn't an angle."""
    need = F.lit(require_marks) if isinstance(require_marks, bool) else require_marks

    def parsed(s: Column) -> Column:
        d, m, sec = (group(s, java(DMS), i) for i in (1, 2, 3))
        bad = F.coalesce(m.cast("int") >= 60, F.lit(False)) | F.coalesce(sec.cast("double") >= 60, F.lit(False))
        text = F.concat(d, F.lit("°"), F.coalesce(F.concat(m, F.lit("'")), F.lit("")), F.coalesce(F.concat(sec, F.lit('"')), F.lit("")))
        decimal = group(s, java(DECIMAL_DEGREES))
        return F.when(decimal.isNotNull(), F.concat(decimal, F.lit("°"))).when((need & ~has_angle_marks(s)) | bad, None).otherwise(text)

    whole = let(recover_degree_quote(strip(normalize_primes(t))), parsed)
    return F.when(~need | t.rlike(ANGLE_SIGNS), whole)  # most texts are none, and cost one look


def correct_confusables(t: Column) -> Column:
    """struct<text, changed>: letters beside digits become digits, from left to right, so that a
    corrected letter counts as a digit for the next one."""
    table = F.create_map(*[F.lit(x) for kv in CONFUSABLES.items() for x in kv])

    def step(acc: Column, i: Column) -> Column:
        c, before, after = F.substring(t, i, 1), F.right(acc.text, F.lit(1)), F.substring(t, i + 1, 1)
        hit = F.element_at(table, c).isNotNull() & (before.rlike(r"^\d") | after.rlike(r"^\d"))
        return F.struct(
            F.concat(acc.text, F.when(hit, F.element_at(table, c)).otherwise(c)).alias("text"), (acc.changed | hit).alias("changed")
        )

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("changed"))
    places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
    return F.when(t.isNotNull(), F.aggregate(places, start, step))


def strip_dimension_spaces(t: Column) -> Column:
    """Blanks stay between letters only."""
    return F.regexp_replace(t, r"(?<!\p{L}) | (?!\p{L})", "")


def fix_symbols(t: Column) -> Column:
    s = F.replace(F.regexp_replace(normalize_primes(strip(t)), r"\+/[−-]", "±"), F.lit("＋"), F.lit("+"))
    s = F.regexp_replace(F.regexp_replace(s, java(r"^\s*[⊕∅⌀φΦø]"), "Ø"), java(r"^\s*[Rr](?=\d)"), "R")
    return strip(F.regexp_replace(F.regexp_replace(s, java(r"""\s*([±°Ø'"])\s*"""), "$1"), java(r"\s+"), " "))


def fix_symbols_client(t: Column) -> Column:
    """Like fix_symbols, but primes, the full-width plus and a leading r stay."""
    s = F.regexp_replace(F.regexp_replace(js_strip(t), r"\+/[−-]", "±"), f"^{JS_S}*[⊕∅⌀φΦø]", "Ø")
    return js_strip(F.regexp_replace(F.regexp_replace(s, f"""{JS_S}*([±°Ø'"]){JS_S}*""", "$1"), f"{JS_S}+", " "))


def is_tolerance_pair(main: Column, tol: Column, need_point: bool = True) -> Column:
    """Whether the second number looks like a tolerance of the first."""
    m, t = main.try_cast("double"), tol.try_cast("double")
    wide = (t < m) & tol.contains(".") if need_point else t < m
    return F.coalesce((t > 0) & (m > 0) & (t < m * 0.5) & ((t <= 2.0) | wide), F.lit(False))


def _with_tolerance(s: Column) -> Column:
    """``s`` as nominal ± tolerance by the first misreading that fits, or as it is."""

    def pair(main: Column, tol: Column) -> Column:
        return let(F.struct(main.alias("m"), tol.alias("t")), lambda x: F.when(is_tolerance_pair(x.m, x.t), F.concat(x.m, F.lit("±"), x.t)))

    of = lambda pattern: [group(s, pattern, i) for i in (1, 2, 3, 4)[: pattern.count("(") - pattern.count("(?:")]]
    point, tries = F.lit("."), []
    a, b, c, d = of(COMMA_TOLERANCE)
    tries.append(pair(F.concat(a, point, b), F.concat(c, point, d)))
    a, b, c = of(GLUED_TOLERANCE)
    tries.append(pair(a, F.concat(b, point, c)))
    tries.append(pair(*of(PLUS_TOLERANCE)))
    a, b, c = of(SPLIT_TOLERANCE)
    tries.append(pair(a, F.coalesce(F.concat(b, point, c), F.concat(F.lit("0."), F.lpad(b, 2, "0")))))
    return F.coalesce(*tries, s)


def normalize_cad_number(t: Column) -> Column:
    """Canonical text of a misread number: an angle, or nominal ± tolerance, or as it is."""
    plain = F.translate(strip_dimension_spaces(strip(normalize_primes(t))), "'\"", "")
    misread = let(plain, lambda s: F.when(s.rlike(MISREAD), let(F.regexp_replace(s, COMMA_DECIMAL, "$1.$2.$3"), _with_tolerance)).otherwise(s))
    # a text without a blank, point or comma has nothing to repair but its quotes
    return F.coalesce(parse_dms(t), F.when(t.rlike(r"[.,\s]|[^\x00-\x7f]"), misread).otherwise(F.translate(t, "'\"", "")))


def leading_symbol(t: Column) -> Column:
    """struct<symbol, rest>; symbol is Ø, R or empty."""
    p = java(r"^\s*([ØøφΦ⌀Rr])\s*(.*)$")
    s = F.regexp_extract(t, p, 1)
    rest = F.when(s != "", F.regexp_extract(t, p, 2)).otherwise(t)
    return F.struct(F.when(s == "", "").when(F.lower(s) == "r", "R").otherwise("Ø").alias("symbol"), rest.alias("rest"))


def has_plus_minus(t: Column) -> Column:
    return t.rlike(r"±|\+/-")


def has_diameter_marker(t: Column) -> Column:
    return t.rlike(java(rf"^\s*{PHI}"))


def has_radius_marker(t: Column) -> Column:
    return t.rlike(java(r"^\s*[Rr]\d"))


def symbols_of_prefix(t: Column) -> Column:
    """struct<diameter, diameter_score, plus_minus, degree, radius> that a text shows.  A lone letter
    that Ø is misread as raises the score only."""
    s = strip(t)
    mark = s.rlike(f"^{PHI}")
    score = F.when(mark, 1.0).when(s.rlike("^[O0Q©¢C]$"), 0.55).otherwise(0.0)
    return F.struct(
        mark.alias("diameter"), score.alias("diameter_score"), has_plus_minus(s).alias("plus_minus"),
        s.rlike(DEGREE).alias("degree"), s.rlike(r"^[Rr]\d").alias("radius"),
    )


def merge_symbol_hints(t: Column, hints: Column) -> Column:
    """Client-side: Ø, ± and ° that the picture shows and the text lacks."""
    s = js_strip(t)
    bare = F.regexp_replace(s, f"^[{JS_SPACE}\\[({{]*[φΦ⌀ø]{JS_S}*", "Ø")
    diameter = (F.coalesce(hints.diameter_score, F.lit(0.0)) >= 0.32) & ~s.startswith("Ø") & ~s.startswith("R")
    s = F.when(js_strip(t) == "", s).when(diameter, F.when(bare.startswith("Ø"), bare).otherwise(F.concat(F.lit("Ø"), bare))).otherwise(s)
    pair = rf"^(\d+\.?\d*){JS_S}+(\d+\.?\d*){JS_S}*$"
    fits = is_tolerance_pair(F.regexp_extract(s, pair, 1), F.regexp_extract(s, pair, 2), need_point=False)
    s = F.when(F.coalesce(hints.plus_minus, F.lit(False)) & ~has_plus_minus(s) & fits, F.regexp_replace(s, pair, "$1±$2")).otherwise(s)
    first = rf"(?s)^(.*?\d){JS_S}*['′]"
    return F.when(F.coalesce(hints.degree, F.lit(False)) & ~s.contains("°"), F.regexp_replace(s, first, "$1°")).otherwise(s)


def derive_range(t: Column) -> Column:
    """``+x, -x`` of the first number behind the first ±, else empty."""
    x = F.regexp_extract(t, r"(?s)^[^±]*±.*?(\d*\.?\d+)", 1)
    return F.when(x != "", F.concat(F.lit("+"), x, F.lit(", -"), x)).otherwise("")


def value_with_range(value: Column, tolerance: Column) -> Column:
    return F.when(F.coalesce(tolerance, F.lit("")) != "", F.concat_ws(" ", value, tolerance)).otherwise(value)


def detail_line(kind: Column, tool: Column, tolerance: Column) -> Column:
    empty = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" · ", empty(kind), empty(tool), F.concat(F.lit("± "), empty(tolerance)))


def escape_xml(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def orientation_of_box(w: Column, h: Column) -> Column:
    """Only a tall box tells; a square one isn't known to be turned."""
    return F.when(h / F.greatest(w, F.lit(1)) > 2.5, "vertical").otherwise("horizontal")


def orientation_of_angle(angle: Column) -> Column:
    a = F.pmod(angle, F.lit(180.0))
    return F.when((a < 15) | (a > 165), "horizontal").when((a > 75) & (a < 105), "vertical").otherwise("rotated")
