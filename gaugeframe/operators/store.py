"""The annotation store: annotations(project_id, id, number, kind, label, value, type, label_id, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import ids
from ..functions import text as X


def KIND():
    return F.coalesce("kind", F.lit("dimension"))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, parts: int = 64) -> DataFrame:
    """``df`` with the row number ``name`` inside its group, by ``order`` (its first column a number).  Rows
    are dealt by ranges of that number, counted, and numbered inside a range behind the counts of the
    ranges before: a group of many rows is many tasks' work."""
    found = df.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)]).alias("b")).first()
    bounds = sorted(set(found.b or []))
    part = F.lit(0)
    for b in bounds:
        part = part + F.when(F.col(order[0]) > b, 1).otherwise(0)
    d = df.withColumn("_part", part)
    counts = d.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a group
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return d.withColumn(name, own).join(counts, same).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*df.columns, name)


def load(annotations: DataFrame, project: str) -> DataFrame:
    return annotations.where(F.col("project_id") == project).drop("project_id")


def fetch(project_ids: DataFrame, projects: DataFrame, annotations: DataFrame) -> DataFrame:
    """project_ids(project_id) with each project's name, less its extension ("Drawing" where there is no such
    project), beside its annotations, whose columns are null where there are none."""
    p = project_ids.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id", "left")
    return p.withColumn("name", ids.without_extension(F.coalesce("name", F.lit("Drawing")))).join(annotations, "project_id", "left")


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("updated_at"))


def most_recent(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("updated_at"), "id").limit(1)


def replace_project(annotations: DataFrame, new: DataFrame, project: str) -> DataFrame:
    """All rows of one project give way to ``new``."""
    return annotations.where(F.col("project_id") != project).unionByName(new.withColumn("project_id", F.lit(project)))


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def delete_project(projects: DataFrame, annotations: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    return projects.where(F.col("id") != project), annotations.where(F.col("project_id") != project)


def remove(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    """Without cascade: children keep a dangling label_id."""
    return annotations.join(ids.select("id"), "id", "left_anti")


def next_number(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy(KIND().alias("kind")).agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_number"))


def add(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (with seq) appended, numbered on from each kind's largest number."""
    top = annotations.groupBy(KIND().alias("kind2")).agg(F.max("number").alias("top"))
    n = ranked(new.withColumn("kind", KIND()), ["kind"], ["seq"], "_rank").join(top, F.col("kind") == F.col("kind2"), "left")
    number = F.col("_rank") + F.coalesce("top", F.lit(0))
    return annotations.unionByName(n.withColumn("number", number.cast(annotations.schema["number"].dataType)).select(annotations.columns))


def patch(annotations: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """changes(id, set array<string>, …): the named columns take the change's value, null too."""
    c = changes.select(F.col("id"), F.col("set"), *[F.col(k).alias(f"new_{k}") for k in columns])
    d = annotations.join(c, "id", "left")
    new = {k: F.when(F.coalesce(F.array_contains("set", k), F.lit(False)), F.col(f"new_{k}")).otherwise(F.col(k)) for k in columns}
    return d.withColumns(new).select(annotations.columns)


def from_regions(regions: DataFrame) -> DataFrame:
    """Readings with text as unnumbered annotations."""
    d = regions.where(X.strip(F.coalesce("text", F.lit(""))) != "").withColumn("type", C.classify(F.col("text")))
    return d.withColumns({"label": C.suggest_label(F.col("type"), F.col("text")), "value": F.col("text"), "kind": F.lit("dimension")})


def saveable(drafts: DataFrame) -> DataFrame:
    return drafts.where(X.strip(F.coalesce("value", F.lit(""))) != "")


def related(annotations: DataFrame, selected: str) -> DataFrame:
    """ids of the selected annotation, its label and what maps to it."""
    mine = F.col("id") == selected
    parent = annotations.where(mine).select(F.col("label_id").alias("id")).where("id is not null")
    return annotations.where(mine | (F.col("label_id") == selected)).select("id").union(parent.join(annotations.select("id"), "id", "left_semi")).distinct()


def on_page(annotations: DataFrame, page: int) -> DataFrame:
    return annotations.where(F.col("page") == page)


def balloons(annotations: DataFrame) -> DataFrame:
    """Annotations with ``place`` in balloon order: by number, then as they came (seq), in a project."""
    return ranked(annotations, ["project_id"], ["number", "seq"], "place")


def from_drafts(drafts: DataFrame, labels: DataFrame) -> DataFrame:
    """Saved drafts(id, kind, value, type, label_id, method, tool, range, box, value_box) as annotations:
    blanks become null, a dimension takes the text of its label, a label none, and the value's own
    box counts before the drawn one.  labels(id, text)."""
    blank = lambda c: F.nullif(X.strip(F.col(c)), F.lit(""))
    kind = F.coalesce("kind", F.lit("dimension"))
    names = labels.select(F.col("id").alias("_id"), F.col("text").alias("_text")).dropDuplicates(["_id"])
    d = saveable(drafts).withColumns({"kind": kind, "label_id": F.when(kind != "label", blank("label_id"))})
    d = d.join(names, F.col("label_id") == F.col("_id"), "left")
    made = {"label": F.coalesce("_text", F.lit("")), "value": X.strip(F.col("value")), "box": F.coalesce("value_box", "box")}
    return d.withColumns(made | {c: blank(c) for c in ("method", "tool", "range")}).drop("_id", "_text", "value_box")


def edit_labels(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(id, text, value, range, method, tool), of labels: the label takes the text for its value; the
    first dimension mapped to it (if any) takes the edit's value with its type, range, method and
    tool, blanks as nulls, and the text for its label."""
    e = edits.select(*[F.col(c).alias(f"_{c}") for c in ("id", "text", "value", "range", "method", "tool")]).dropDuplicates(["_id"])
    blank = lambda c: F.nullif(c, F.lit(""))
    trimmed = lambda c: X.js_strip(F.col(c))
    first = annotations.where((KIND() == "dimension") & F.col("label_id").isNotNull()).groupBy("label_id").agg(F.min_by("id", F.struct("number", "id")).alias("_to"))
    labels = e.join(annotations.where("kind = 'label'").select(F.col("id").alias("_id")).distinct(), "_id")
    on_value = labels.join(first, F.col("_id") == F.col("label_id")).drop("label_id")
    d = annotations.join(labels.select(F.col("_id").alias("id"), trimmed("_text").alias("_own")), "id", "left")
    on_value = on_value.select(
        F.col("_to").alias("id"), trimmed("_text").alias("_label"), trimmed("_value").alias("_v"), C.classify(F.col("_value")).alias("_type"),
        blank(trimmed("_range")).alias("_r"), blank(trimmed("_method")).alias("_m"), blank(F.col("_tool")).alias("_t"), F.lit(True).alias("_hit"),
    )
    d = d.join(on_value, "id", "left")
    new = {"value": "_v", "type": "_type", "range": "_r", "method": "_m", "tool": "_t", "label": "_label"}
    made = {c: F.when(F.col("_hit"), F.col(k)).otherwise(F.coalesce("_own", "value") if c == "value" else F.col(c)) for c, k in new.items()}
    return d.withColumns(made).select(annotations.columns)


def set_fields(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(id, label_id, field, value), one an id and field, field of label, value, range, method and tool.
    The dimension takes the edit; a label written beside a mapped dimension goes to the label's value
    too; a value brings its type."""
    fields = ("label", "value", "range", "method", "tool")
    own = edits.groupBy("id").agg(*[F.max(F.when(F.col("field") == k, F.struct(F.col("value").alias("v")))).alias(f"_{k}") for k in fields])
    up = edits.where("field = 'label' and label_id is not null").groupBy(F.col("label_id").alias("id")).agg(F.max(F.struct(F.col("value").alias("v"))).alias("_up"))
    d = annotations.join(own, "id", "left").join(up, "id", "left")
    new = {k: F.when(F.col(f"_{k}").isNotNull(), F.col(f"_{k}.v")).otherwise(F.col(k)) for k in fields}
    new["value"] = F.when(F.col("_up").isNotNull(), F.col("_up.v")).otherwise(new["value"])
    new["type"] = F.when(F.col("_value").isNotNull(), C.classify(F.col("_value.v"))).otherwise(F.col("type"))
    return d.withColumns(new).select(annotations.columns)


def set_extras(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(id, extras map): merged into the extras, the edit's keys over the old ones."""
    e = edits.select("id", F.col("extras").alias("_e"))
    none = F.create_map().cast("map<string,string>")
    old = lambda: F.map_filter(F.coalesce("extras", none), lambda k, _: ~F.map_contains_key(F.coalesce("_e", none), k))
    return annotations.join(e, "id", "left").withColumn("extras", F.map_concat(old(), F.coalesce("_e", none))).select(annotations.columns)
