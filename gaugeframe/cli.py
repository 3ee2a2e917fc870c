"""Command line: one JSON object on standard output, whatever happens; all else goes to standard error.

python -m gaugeframe.cli health
python -m gaugeframe.cli lines RESULT.json       recognised lines of a recogniser's result
python -m gaugeframe.cli convert IN.json FOLDER  an inspection file's checksheet template
python -m gaugeframe.cli query NAME FOLDER       the rows of a registered query"""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def health(args) -> dict:
    return {"status": "ok", "spark": session().version}


def lines(args) -> dict:
    from .sources.files import recognised

    with open(args.path, encoding="utf-8") as f:
        found = recognised(json.load(f))
    names = ("text", "x", "y", "width", "height", "confidence")
    return {"count": len(found), "lines": [dict(zip(names, r, strict=True)) for r in found]}


def convert(args) -> dict:
    from .sources.files import convert_file

    return {"ok": True, "path": convert_file(session(), args.path, args.folder, overwrite=not args.keep)}


def query(args) -> dict:
    from .plans.queries import QUERIES

    rows = [json.loads(r) for r in QUERIES[args.name](session(), args.folder).toJSON().collect()]
    return {"count": len(rows), "rows": rows}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugeframe", description="Inspection analytics; standard output is JSON only.")
    ops = p.add_subparsers(dest="op", required=True)
    ops.add_parser("health").set_defaults(run=health)
    for name, run, args in (("lines", lines, ["path"]), ("convert", convert, ["path", "folder"]), ("query", query, ["name", "folder"])):
        o = ops.add_parser(name)
        o.set_defaults(run=run)
        for a in args:
            o.add_argument(a)
        if name == "convert":
            o.add_argument("--keep", action="store_true", help="fail rather than replace a template")
    return p


@contextlib.contextmanager
def only_json():
    """The real standard output, while file descriptor 1 is standard error: the JVM's chatter too."""
    sys.stdout.flush()
    real = os.dup(1)
    os.dup2(2, 1)
    try:
        with os.fdopen(os.dup(real), "w") as out:
            yield out
    finally:
        sys.stdout.flush()
        os.dup2(real, 1)
        os.close(real)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    with only_json() as out:
        try:
            answer, code = args.run(args), 0
        except Exception as e:  # noqa: BLE001  (any failure is an answer)
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            answer, code = {"ok": False, "error": f"{type(e).__name__}: {e}"}, 1
        out.write(json.dumps(answer, ensure_ascii=False, default=str) + "\n")
    return code


if __name__ == "__main__":
    sys.exit(main())
