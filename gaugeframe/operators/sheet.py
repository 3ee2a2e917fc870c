"""Inspection sheets, and the ways out of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions import text as X
from . import pieces as P

FIXED = ["S.no", "Label", "Value", "Tolerance"]


def _full(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def with_parent(annotations: DataFrame, within: list[str] = ()) -> DataFrame:
    """Every dimension with its parent's value, method and tool; the first of equal ids counts.  Parents have the
    dimension's own columns ``within``."""
    first = Window.partitionBy(*within, "id").orderBy("number")
    p = annotations.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    p = p.select(*[F.col(c).alias(f"_p_{c}") for c in within], F.col("id").alias("parent_id"), F.col("value").alias("parent_value"), F.col("method").alias("parent_method"), F.col("tool").alias("parent_tool"))
    dims = annotations.where(F.coalesce("kind", F.lit("dimension")) == "dimension")
    return dims.join(p, [F.col("label_id") == F.col("parent_id"), *[F.col(c) == F.col(f"_p_{c}") for c in within]], "left")


def inspection_sheet(annotations: DataFrame, extra: list[str] = (), keep: list[str] = (), within: list[str] = ()) -> DataFrame:
    """The sheet's columns as strings, number to order by, and the columns to ``keep``.  ``within``: as in ``with_parent``."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    extras = [blank(F.element_at("extras", k)).alias(k) for k in extra]
    return with_parent(annotations, within).select(
        *keep, "number", F.col("number").cast("string").alias("S.no"), blank(F.coalesce("parent_value", "label")).alias("Label"), blank(F.col("value")).alias("Value"),
        blank(F.col("range")).alias("Tolerance"), *extras, blank(F.coalesce(_full("method"), _full("parent_method"))).alias("Method"), blank(F.coalesce(_full("tool"), _full("parent_tool"))).alias("Tool"),
    )


def inspection_json_lines(sheet: DataFrame) -> DataFrame:
    """sheet with project_id: the objects of a project's json, in pieces.  Of equal headers the last one's value
    counts, in the first one's place; headers that are whole numbers come first, as in any JavaScript
    object."""
    cols = _cells(sheet.columns)
    whole = sorted((c for c in cols if c.isdigit() and (c == "0" or c[0] != "0") and int(c) < 2**32 - 1), key=int)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in whole + [c for c in cols if c not in whole]]))
    return P.lines(sheet.select("project_id", "number", row.alias("j")), "project_id", ["number", "j"], F.col("j"), ",")


def inspection_json(sheet: DataFrame, extra: list[str] = ()) -> DataFrame:
    """A project's json, {data, extra_columns}, in one row."""
    tail = json.dumps(list(extra), ensure_ascii=False, separators=(",", ":"))
    return P.joined(inspection_json_lines(sheet), "project_id", "json", ",", '{"data":[', f'],"extra_columns":{tail}}}')


def _cells(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in ("number", "project_id")]


def csv_lines(sheet: DataFrame) -> DataFrame:
    """place (0 for the header, then 1), number and line: the lines of the sheet's CSV, every cell quoted."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))
    names = _cells(sheet.columns)
    head = ",".join('"' + c.replace('"', '""') + '"' for c in names)
    kind = sheet.schema["number"].dataType
    header = sheet.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(None).cast(kind).alias("number"), F.lit(head).alias("line"))
    return header.unionByName(sheet.select(F.lit(1).alias("place"), "number", F.concat_ws(",", *[cell(c) for c in names]).alias("line")))


def csv_files(sheet: DataFrame) -> DataFrame:
    """sheet with project_id: one file's text a project, header first, rows by number and text."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))
    names = _cells(sheet.columns)
    head = ",".join('"' + c.replace('"', '""') + '"' for c in names)
    rows = sheet.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("number", F.concat_ws(",", *[cell(c) for c in names]).alias("line")))).alias("l"))
    return rows.select("project_id", F.concat_ws("\n", F.lit(head), F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("csv"))


def xml_lines(annotations: DataFrame, keep: list[str] = ()) -> DataFrame:
    """number, id and line: an annotation's element, as it stands in the file, and the columns to ``keep``.
    The label is text and may not be null; range, method and tool may."""
    text = lambda c: X.escape_xml(F.coalesce(F.col(c), F.lit("")))
    number = lambda c: ranges.js_number(F.col(c))
    attributes = lambda pairs: F.concat(*[p for k, v in pairs for p in (F.lit(f' {k}="'), v, F.lit('"'))])
    head = attributes([("id", F.col("id")), ("number", F.col("number").cast("string")), ("page", F.col("page").cast("string")), ("type", F.coalesce("type", F.lit(""))), ("confidence", number("confidence"))])
    box = attributes([("x", number("x")), ("y", number("y")), ("width", number("w")), ("height", number("h")), ("rotation", number("rotation"))])
    tags = [p for k in ("value", "label", "range", "method", "tool") for p in (F.lit(f"\n    <{k}>"), text(k), F.lit(f"</{k}>"))]
    line = F.concat(F.lit("  <annotation"), head, F.lit(">"), *tags, F.lit("\n    <bbox"), box, F.lit("/>\n  </annotation>"))
    return annotations.select(*keep, "number", "id", line.alias("line"))


#: What stands around the elements of the XML file.
XML_HEAD, XML_TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<annotations>\n', "\n</annotations>"


def xml_file_lines(annotations: DataFrame) -> DataFrame:
    """A project's elements by number and id, in pieces."""
    return P.lines(xml_lines(annotations, ["project_id"]), "project_id", ["number", "id", "line"], F.col("line"), "\n")


def xml_files(annotations: DataFrame) -> DataFrame:
    """One file's text a project."""
    return P.joined(xml_file_lines(annotations), "project_id", "xml", "\n", XML_HEAD, XML_TAIL)


def _item() -> Column:
    blank = [F.coalesce(c, F.lit("")).alias(k) for c, k in (("method", "method"), ("tool", "tool"), ("range", "range"), ("label_id", "labelId"))]
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    return F.struct("number", "label", "value", "type", F.coalesce("kind", F.lit("dimension")).alias("kind"), *blank, "page", "confidence", box.alias("bbox"))


def verification_payload(annotations: DataFrame) -> DataFrame:
    """The payload's items: label, value and type as they are, blanks for what else is missing, and
    the box as a struct."""
    return annotations.select(_item().alias("i")).select("i.*")


#: Sections of a verification document's pieces that hold lines: the sheet's rows, and the items.
ROWS, ITEMS = 1, 3


def verification_pieces(annotations: DataFrame, projects: DataFrame, endpoint: str = "", extra: list[str] | None = None) -> DataFrame:
    """The pieces of one JSON text a project: projects(project_id, project_name).  With ``extra`` the
    inspection sheet goes with it: its headers, rows by number, and extra columns; a project's rows have parents of
    that project."""
    here = projects.select("project_id").distinct()
    ours = lambda d: d.join(here, "project_id", "left_semi")
    items = ours(annotations).select("project_id", F.struct("number", "id", _item().alias("i")).alias("k")).select("*", F.to_json("k.i").alias("j"))
    head = F.to_json(F.struct(F.col("project_name").alias("projectName"), F.lit(endpoint).alias("endpoint")))
    fixed = lambda text, section: P.fixed(projects, "project_id", text, section)
    head = F.regexp_replace(head, r"\}$", "")
    parts = [P.lines(items, "project_id", ["k"], F.col("j"), ",", ITEMS), fixed(F.lit("]}"), ITEMS + 1)]
    if extra is None:
        return P.together(fixed(F.concat(head, F.lit(',"items":[')), 0), *parts)
    rows = inspection_sheet(ours(annotations), extra, keep=["project_id"], within=["project_id"])
    names = _cells(rows.columns)
    rows = rows.select("project_id", F.struct("number", F.array(*[F.col(f"`{c}`") for c in names]).alias("r")).alias("k")).select("*", F.to_json("k.r").alias("j"))
    strings = lambda xs: json.dumps(list(xs), ensure_ascii=False, separators=(",", ":"))
    start = F.concat(head, F.lit(f',"sheet":{{"headers":{strings(names)},"rows":['))
    end = F.lit(f'],"extraColumns":{strings(extra)}}},"items":[')
    return P.together(fixed(start, 0), P.lines(rows, "project_id", ["k"], F.col("j"), ",", ROWS), fixed(end, ROWS + 1), *parts)


def verification_documents(annotations: DataFrame, projects: DataFrame, endpoint: str = "", extra: list[str] | None = None) -> DataFrame:
    """The same, one row a project."""
    return P.joined(verification_pieces(annotations, projects, endpoint, extra), "project_id", "json", ",")


def read_documents(annotations: DataFrame, projects: DataFrame, reader: Callable[[Iterator[bytes]], tuple], schema: str, endpoint: str = "", extra: list[str] | None = None) -> DataFrame:
    """What ``reader`` makes of each whole document, a row a project: the text of ``verification_documents``, of any length."""
    return P.read(verification_pieces(annotations, projects, endpoint, extra), "project_id", reader, schema, ",")


def training_labels(rows: DataFrame) -> DataFrame:
    """rows(id, cells map, bbox): text is the key ``value``; defaults where a key is missing; a null stays null."""
    get = lambda k, default: F.when(F.map_contains_key("cells", k), F.element_at("cells", k)).otherwise(F.lit(default))
    return rows.select("id", get("value", "").alias("text"), get("label", "").alias("label"), get("type", "Unknown").alias("type"), "bbox")


def unmapped_values(annotations: DataFrame) -> DataFrame:
    """Dimensions without a label, or whose label isn't there."""
    labels = annotations.where("kind = 'label'").select(F.col("id").alias("label_id")).distinct()
    return annotations.where(F.coalesce("kind", F.lit("dimension")) == "dimension").join(labels, "label_id", "left_anti")


def label_values(annotations: DataFrame) -> DataFrame:
    """Every label with its first dimension's id and value."""
    dims = annotations.where(F.coalesce("kind", F.lit("dimension")) == "dimension")
    first = dims.groupBy("label_id").agg(F.min_by(F.struct("id", "value"), F.struct("number", "id")).alias("d"))
    labels = annotations.where("kind = 'label'").select("id", F.col("value").alias("label_value"))
    return labels.join(first, F.col("id") == F.col("label_id"), "left").select("id", "label_value", F.col("d.id").alias("value_id"), F.col("d.value").alias("value"))


def attachable_labels(annotations: DataFrame) -> DataFrame:
    used = annotations.where(F.coalesce("kind", F.lit("dimension")) == "dimension").select(F.col("label_id").alias("id"))
    return annotations.where("kind = 'label'").where(X.strip(F.coalesce("value", F.lit(""))) != "").join(used, "id", "left_anti")


def counts(annotations: DataFrame) -> DataFrame:
    """Labels, and dimensions without a label or whose label isn't there."""
    labels = annotations.where("kind = 'label'").select(F.col("id").alias("_l")).distinct()
    return annotations.join(labels, F.col("label_id") == F.col("_l"), "left").agg(F.count_if(F.col("kind") == "label").alias("labels"), F.count_if((F.coalesce("kind", F.lit("dimension")) == "dimension") & F.col("_l").isNull()).alias("without_label"))


def part_columns(rows: DataFrame) -> DataFrame:
    """rows(cells map): the part columns by number, then name."""
    k = rows.select(F.explode(F.map_keys("cells")).alias("name")).where(F.col("name").rlike("(?i)^part[0-9]+$")).distinct()
    return k.withColumn("number", F.regexp_extract("name", r"\d+", 0).cast("long")).orderBy("number", "name")


def column_names(n: int, names: list[str] | None = None, least: int = 1) -> list[str]:
    """Names of n extra columns, n held in least to 20; blank ones are numbered."""
    n = max(least, min(20, n))
    names = names if names is not None else [f"part{i + 1}" for i in range(n)]
    return [(names[i].strip() if i < len(names) else "") or f"col{i + 1}" for i in range(n)]


def sheet_columns(annotations: DataFrame, named: list[str] = ()) -> DataFrame:
    """(place, name): the named columns as they are, then the keys of extras(number, extras map) that
    they lack, by where they were first seen."""
    spark = annotations.sparkSession
    first = spark.createDataFrame([(0, i, 0, n) for i, n in enumerate(named)], "part int, a long, b int, name string")
    keys = annotations.select("number", F.posexplode(F.map_keys("extras")).alias("pos", "name"))
    seen = keys.groupBy("name").agg(F.min(F.struct("number", "pos")).alias("at")).where(~F.col("name").isin(list(named)))
    d = first.unionByName(seen.select(F.lit(1).alias("part"), F.col("at.number").cast("long").alias("a"), F.col("at.pos").alias("b"), "name"))
    return d.select((F.row_number().over(Window.orderBy("part", "a", "b")) - 1).alias("place"), "name")  # a few names


def label_options(annotations: DataFrame) -> DataFrame:
    """(id, number, text) of the labels whose value has text, which is trimmed."""
    return annotations.where("kind = 'label'").select("id", "number", X.js_strip(F.col("value")).alias("text")).where("text <> ''")
