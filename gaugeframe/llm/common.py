"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.tables import materialise, release, shared_dir

__all__ = ["ASCII_SPACE", "forget_shuffles", "give_back", "holdout", "let", "materialise", "per_text", "release", "shared_dir", "ship", "small", "table", "worker_memo"]

#: ASCII white space: what separates words in the contracts of operators 4, 5 and 6.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that workers can import it
    wherever they run."""
    sc = spark.sparkContext
    if getattr(ship, "context", None) is sc:
        return
    root = Path(__file__).parents[1]
    path = Path(tempfile.mkdtemp(prefix="gaugeframe-code-")) / "gaugeframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    ship.context = sc


_slot: dict = {}


def worker_memo(key: tuple, make):
    """``make()``, kept in this worker process until an operator asks for another: workers serve
    one stage after the other, and shouldn't hold the memos of all."""
    if _slot.get("key") != key:
        if _slot:
            _slot.clear()
            give_back()
        _slot.update(key=key, value=make())
    return _slot["value"]


def give_back() -> None:
    """Return freed memory to the system: allocators keep it, and a worker lives on idle."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no table refers to any more, now rather than at some
    later collection of garbage: Python's references go first, then the driver's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(batches, rows: int = 1000):
    """The batches in slices of at most so many rows: what Python makes of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable, so that
    an expensive expression used inside another lambda isn't evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holdout(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32(id as text) mod ``modulus`` is ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def per_text(docs: DataFrame, make, columns: dict[str, str], id_col="doc_id", text_col="text", extra: dict | None = None) -> DataFrame:
    """doc_id and ``columns`` (name to type) per row: ``make()`` runs once a task and returns a
    function from a batch's texts (null: empty) to the columns' values.  The id, and ``extra``
    columns (name to Column, given to the function after the texts), never pass through
    pandas, so a long beside a null stays exact."""
    ship(docs.sparkSession)
    extra = extra or {}
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[c.alias(k) for k, c in extra.items()],
    )
    names = ["doc_id", *columns]

    def run(batches):
        import pyarrow as pa

        f = make()
        for b in small(batches):
            made = f(b.column(1).to_pylist(), *[b.column(i).to_pylist() for i in range(2, b.num_columns)])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(made[k], type=kinds[k]) for k in columns]], names=names)

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in columns.items())
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    return d.mapInArrow(run, schema)
