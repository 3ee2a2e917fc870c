"""Files, settings and the command line."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeframe.sources import config, files

ROOT = Path(__file__).parents[1]
CELLS = [{"S.no": "1", "Label": "Bore", "Value": "58.21±0.05", "part2": "", "Part1": ""}, {"S.no": "2", "Value": "R5", "part1": ""}]


def test_env_files(tmp_path):
    (tmp_path / ".env.local").write_text("# no\nA = 1 \nB=\"x y\"\nC='open\nnot a line\n=empty\n  D=\n")
    (tmp_path / ".env").write_text("A=2\nE=a=b\nF=\n")
    env = {"B": "kept"}
    config.load_env(str(tmp_path), env)
    assert env == {"A": "1", "B": "kept", "C": "'open", "D": "", "E": "a=b", "F": ""}
    e = {"yes": " ON ", "no": "0", "n": " 12 ", "bad": "1.5", "blank": "  ", "list": " a, ,b ,"}
    assert config.get_bool("yes", env=e) and not config.get_bool("no", True, e) and config.get_bool("none", True, e) and not config.get_bool("blank", True, e)
    assert (config.get_int("n", 3, e), config.get_int("bad", 3, e), config.get_int("blank", 3, e), config.get_int("none", 3, e)) == (12, 3, 3, 3)
    assert config.get_str("blank", "d", e) == "d" and config.get_str("n", "d", e) == "12"
    assert config.get_list("list", e) == ["a", "b"] and config.get_list("blank", e) is None


def test_api_url():
    url = lambda **e: config.api_url({f"NEXT_PUBLIC_OCR_API_{k}": v for k, v in e.items()})
    assert url() == "http://localhost:8000" and url(URL=" https://a.b/// ", HOST="c") == "https://a.b"
    assert url(HOST="h/", PORT="9") == "http://h:9" and url(HOST="HTTPS://h") == "HTTPS://h:8000"


def test_convert_file(spark, tmp_path):
    source = tmp_path / "TS2 face cone.v1.json"
    source.write_text(json.dumps({"data": [*CELLS, None]}))
    path = files.convert_file(spark, str(source), str(tmp_path / "out"))
    assert Path(path).name == "TS2_FACE_CONE_V1.json"
    made = json.loads(Path(path).read_text())
    assert [c["items"][0]["label"]["en"] for c in made["items"][0]["items"]][6:] == ["Part1", "part1", "part2"] and len(made["items"]) == 3
    with pytest.raises(FileExistsError):
        files.convert_file(spark, str(source), str(tmp_path / "out"), overwrite=False)


def test_index_file(spark, tmp_path):
    path = str(tmp_path / "index.json")
    index = spark.createDataFrame([(1, "b", "fb", "n", ["u"]), (0, "a", "fa", "é", ["u", "v"])], "pos int, id string, file string, name string, users array<string>")
    files.save_index(index, path)
    assert Path(path).read_text().startswith('[\n    {\n        "id": "a",') and "é" in Path(path).read_text()
    assert [tuple(r) for r in files.index_entries(spark, path).orderBy("pos").collect()] == [(0, "a", "fa", "é", ["u", "v"]), (1, "b", "fb", "n", ["u"])]
    for text, error in (("{", "invalid JSON"), ("{}", "not a JSON array"), ("[1]", "not a JSON object")):
        Path(path).write_text(text)
        with pytest.raises(Exception, match=error):
            files.index_entries(spark, path).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.index_entries(spark, str(tmp_path / "none.json"))


def test_dump_steps(spark, tmp_path):
    rows = [("k1", 1, "raw", "txt", bytearray(b"a")), ("k1", 2, "cw_cad", "txt", bytearray(b"b")), ("k2", 1, "raw", "txt", bytearray(b"c"))]
    steps = spark.createDataFrame(rows, "key string, number int, name string, ext string, data binary")
    assert sorted(files.dump_steps(steps.where("key = 'k1'"), str(tmp_path))) == ["k1"]
    assert files.dump_steps(steps, str(tmp_path)) == ["k2"] and sorted(files.dump_steps(steps, str(tmp_path), force=True)) == ["k1", "k2"]
    assert (tmp_path / "k1" / "02_cw_cad.txt").read_bytes() == b"b"


def test_data_urls_and_pictures(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"ABC")
    (tmp_path / "b.txt").write_bytes(b"no")
    d = files.pictures(spark, str(tmp_path))
    url = d.select(files.data_url(F.lit("image/png"), F.col("content")).alias("u"))
    assert [r.u for r in url.collect()] == ["data:image/png;base64,QUJD"]
    assert bytes(url.select(files.data_url_bytes(F.col("u")).alias("b")).first().b) == b"ABC"


def test_command_line(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "gaugeframe.cli", *a], cwd=ROOT, capture_output=True, text=True, timeout=120)
    (tmp_path / "r.json").write_text('{"res":{"rec_text":"12.5","rec_score":0.9}}')
    ran = run("lines", str(tmp_path / "r.json"))
    assert ran.returncode == 0 and json.loads(ran.stdout) == {"count": 1, "lines": [{"text": "12.5", "x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0, "confidence": 0.9}]}
    ran = run("lines", str(tmp_path / "none.json"))
    assert ran.returncode == 1 and json.loads(ran.stdout)["ok"] is False and "FileNotFoundError" in json.loads(ran.stdout)["error"]
    assert run("unknown").returncode == 2
