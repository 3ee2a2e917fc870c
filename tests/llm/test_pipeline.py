from collections import Counter

import corpus_pipeline
from gaugeframe.llm import langid, neardup, packing, quality

from .cases import SF, awkward, empty, rows


def test_stages_by_brute_force(spark):
    """Each stage does to its input what its operator says of every row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (_, stage), verdict, keep in zip(
        corpus_pipeline.STAGES,
        (quality.line_quality, langid.identify, neardup.near_duplicates),
        (lambda r: r["kept"], lambda r: not r["rejected"], lambda r: r["kept"]),
    ):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        want = Counter(r["doc_id"] for r in rows(verdict(docs)) if keep(r))
        assert Counter(r["doc_id"] for r in rows(out)) == want
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = rows(corpus_pipeline.STAGES[3][1](spark, docs, SF))
    assert {r["doc_id"] for r in packed} == {r.doc_id for r in docs.collect()}
    ran = rows(corpus_pipeline.run(spark, SF))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in ran) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert packing


def test_stages_on_awkward_and_empty(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_quality_stage_removes_lines(spark):
    own = lambda i: "\n\n  ".join(" ".join(f"w{i}x{k}x{j}" for j in range(30)) for k in range(3))
    data = [(i, f"Home  About\n{own(i)}\n \nhome about\nrare line {i % 2}\n" if i < 25 else own(i), "en", "h", 0) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in rows(corpus_pipeline.STAGES[0][1](spark, df, SF))}
    assert len(got) == 200
    for i, r in got.items():
        assert r["text"] == (f"{own(i)}\n \nrare line {i % 2}\n" if i < 25 else own(i)) and r["n_chars"] == len(r["text"])


def test_dedup_stage_keeps_null_ids_and_one_row_of_copies(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    data = [(None, text(0)), (None, text(0)), (None, text(1)), (None, text(2) + " end"), (7, text(2)), (8, text(3)), (8, text(3)), (8, text(4)), (9, text(3)), (None, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in rows(corpus_pipeline.STAGES[2][1](spark, df, SF)))
    assert got == Counter([(None, text(0)), (None, text(1)), (7, text(2)), (8, text(3)), (8, text(4)), (None, None), (5, "")])
