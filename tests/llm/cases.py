"""Small tables with the awkward cases, and brute-force versions."""

import duckdb

SF = "/root/testdata/sf0.001"
#: Null ids, texts, languages and sources; empty, blank, short, repeated and long texts.
ROWS = [
    (1, "a b c d e f", "en", "s", 9),
    (1, "a b c d e f", "en", "s", 9),
    (1, "other words under the same id here", "en", "s", 9),
    (2, None, None, None, 0),
    (3, "", "en", "s", 0),
    (4, " \n\t \x0b", "de", None, 0),
    (5, "one", "fr", "s", 1),
    (6, "ONE", None, "s", 1),
    (None, "a b c d e f", "en", "s", 1),
    (7, "All rights reserved. CC-BY cc by all rights RESERVED", "en", "t", 1),
    (8, "été Ünïcode ß \u00a0 x\u2003y \x1c z\U0001f600", "fr", "t", 1),
    (9, "12345 !!! ...", "es", "t", 1),
    (2**60 + 1, "word " * 30000, "en", "t", 1),
    (10, "\n".join(["same line here", "Same  line here", "", "x y z x y z x y z"]), "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Other columns whose names an operator might use itself.
CLASHING = ["h", "n", "v", "rep", "comp", "group", "block", "kept", "words", "host", "host2", "row", "lines", "score", "id", "label"]


def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf=SF):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet' order by doc_id").fetchall()


def rows(df):
    return [r.asDict() for r in df.collect()]
