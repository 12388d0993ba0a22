import json
import os
from dataclasses import replace
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from simweave.__main__ import main
from simweave.engine import Engine
from simweave.plans import report
from simweave.sources import config

BODY = "    int total = 0;\n    for (int i = 0; i < values.length; i++) {\n      total += values[i];\n      total *= factor;\n      total -= offset;\n      total ^= mask;\n      total |= bits;\n    }\n    return total;\n"


def source(name, body=BODY, method="total"):
    return f"public class {name} {{\n  public int {method}(int[] values, int factor) {{\n{body}  }}\n}}\n"


@pytest.fixture
def tree(tmp_path):
    os.makedirs(tmp_path / "src/test")
    for n in ("A", "B"):
        (tmp_path / f"src/{n}.java").write_text(source(n))
    (tmp_path / "src/C.java").write_text(source("C", "    String s = name + other;\n    print(s);\n    send(s, name);\n    return s.length();\n", "say"))
    (tmp_path / "src/test/T.java").write_text(source("T"))
    return tmp_path


def ids(doc):
    return {(p["left"]["name"], p["right"]["name"]) for p in doc["duplicates"] if p["unit_type"] == "function"}


def test_life_of_an_index(spark, tree):
    e = Engine(spark, str(tree))
    e.init()
    assert {r["file_path"] for r in e.store.read("files").collect()} == {"src/A.java", "src/B.java", "src/C.java"}
    assert e.update().count() == 0
    first = e.report(at=datetime(2024, 1, 1, tzinfo=UTC))
    assert ("A.total", "B.total") in ids(first) and not any("C." in n for p in ids(first) for n in p)
    assert set(first["metrics"]["seconds"]) == {"index", "detect", "judge", "total"}
    assert e.source("src/A.java") == source("A")
    for bad in ("../x", "/etc/passwd", "src/../../x", "file:///x"):
        with pytest.raises(ValueError):
            e.source(bad)
    assert first["metrics"]["files_scanned"] == 3 and first["score"]["score"] > 0
    again = e.report(at=datetime(2024, 1, 2, tzinfo=UTC))
    assert [p["id"] for p in again["duplicates"]] == [p["id"] for p in first["duplicates"]]
    assert report.as_text(again).startswith("Score")

    (tree / "src/D.java").write_text(source("D"))
    (tree / "src/B.java").unlink()
    third = e.report(at=datetime(2024, 1, 3, tzinfo=UTC))
    assert ids(third) == {("A.total", "D.total")}
    full = e.report(full=True, at=datetime(2024, 1, 4, tzinfo=UTC))
    assert sorted(p["id"] for p in full["duplicates"]) == sorted(p["id"] for p in third["duplicates"])

    pair = next(p for p in full["duplicates"] if p["unit_type"] == "function")
    key = e.exclude(pair["short_id"])
    assert key == "function|A.total(arity:2)|D.total(arity:2)" and e.exclude("none") is None
    assert ids(e.report(at=datetime(2024, 1, 5, tzinfo=UTC))) == set()
    assert e.clean() == ([key], [])
    (tree / "src/D.java").unlink()
    assert e.clean() == ([], [key])
    assert config.load(str(tree)).excludedPairs == []


def test_verdicts_are_asked_once(spark, tree):
    (tree / "src/D.java").write_text(source("D"))
    prompts = []

    def ask(prompt):
        prompts.append(1)
        return F.when(F.contains(prompt, F.lit("First, A.total in")), "no").otherwise("Yes.")

    e = Engine(spark, str(tree), ask=ask)
    e.init()
    assert ids(e.report(at=datetime(2024, 1, 1, tzinfo=UTC))) == {("B.total", "D.total")}
    cached = {r["pair_key"]: r["verdict"] for r in e.store.read("verdicts").collect()}
    assert cached["function|A.total(arity:2)|B.total(arity:2)"] == "no" and cached["function|B.total(arity:2)|D.total(arity:2)"] == "yes"
    off = Engine(spark, str(tree), ask=lambda prompt: F.lit("no"))
    assert ids(off.report(at=datetime(2024, 1, 2, tzinfo=UTC))) == {("B.total", "D.total")}
    (tree / "src/D.java").write_text(source("D") + "\n// touched\n")
    assert ids(off.report(at=datetime(2024, 1, 3, tzinfo=UTC))) == set()


def test_each_pair_is_asked_once(spark, tree):
    (tree / "src/D.java").write_text(source("D"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(prompt):
        calls.add(1)
        return "yes"

    e = Engine(spark, str(tree), ask=answer)
    e.init()
    first = e.report(at=datetime(2024, 1, 1, tzinfo=UTC))
    assert calls.value == first["pairs"] == e.store.read("verdicts").count() > 2
    e.report(at=datetime(2024, 1, 2, tzinfo=UTC))
    assert calls.value == first["pairs"]
    off = Engine(spark, str(tree), ask=lambda prompt: F.lit("no"))
    assert off.report(at=datetime(2024, 1, 3, tzinfo=UTC), judge=False, full=True)["pairs"] == first["pairs"]


def test_unchanged_files_are_not_opened_and_paths_are_enough(spark, tree):
    e = Engine(spark, str(tree))
    e.init()
    a, b = tree / "src/A.java", tree / "src/B.java"
    for f in (a, b):
        before = os.stat(f)
        f.write_text(source(f.stem, method="other"))
        os.utime(f, ns=(before.st_atime_ns, before.st_mtime_ns))
    assert e.update().count() == 0  # an equal time: not looked into
    os.utime(a, (1, 1))
    os.utime(b, (1, 1))
    only = spark.createDataFrame([("src/A.java",), ("src/none.java",)], "file_path string")
    assert [r["file_path"] for r in e.update(only).collect()] == ["src/A.java"]
    names = lambda: {r["name"] for r in e.store.read("units").where("unit_type = 'function'").collect()}
    assert {"A.other", "B.total"} <= names()
    b.unlink()
    assert [r["file_path"] for r in e.update(spark.createDataFrame([("src/B.java",)], "file_path string")).collect()] == ["src/B.java"]
    assert not any(n.startswith("B.") for n in names())


def test_a_stream_of_edits_updates_the_index(spark, tree, tmp_path_factory):
    e, out = Engine(spark, str(tree)), tmp_path_factory.mktemp("stream")
    e.init()
    (tree / "src/A.java").write_text(source("A", method="edited"))
    (tree / "src/B.java").write_text(source("B", method="edited"))
    t = datetime(2024, 1, 1)
    rows = [(f"{tree}/src/A.java", t, 1), (f"{tree}/src/B.java", t, 0), ("/elsewhere/src/C.java", t, 1), (f"{tree}/zzz", datetime(2024, 1, 2), 1)]
    spark.createDataFrame(rows, "file_path string, ts timestamp, changes int").coalesce(1).write.parquet(f"{out}/in")
    events = spark.readStream.schema("file_path string, ts timestamp, changes int").parquet(f"{out}/in")
    e.watch(events, f"{out}/cp").awaitTermination(120)
    names = {r["name"] for r in e.store.read("units").collect()}
    assert "A.edited" in names and "B.edited" not in names


def test_pages_and_files_of_a_report(spark, tree, tmp_path_factory):
    for n in "DEF":
        (tree / f"src/{n}.java").write_text(source(n))
    e = Engine(spark, str(tree))
    assert e.save() is None
    doc = e.report(at=datetime(2024, 1, 1, tzinfo=UTC))
    assert doc["pairs"] == e.findings().count() > 10
    pages = [e.page(k, 4) for k in range(0, doc["pairs"], 4)]
    assert {p["total"] for p in pages} == {doc["pairs"]}
    assert [r["id"] for p in pages for r in p["rows"]] == [p["id"] for p in doc["duplicates"]][: doc["pairs"]]
    out = str(tmp_path_factory.mktemp("saved"))
    path = e.save(out)
    assert path == f"{out}/dupes-2024-01-01T00-00-00-000Z.json" and json.loads(open(path).read()) == json.loads(json.dumps(doc))
    assert spark.read.json(path.removesuffix(".json") + ".pairs").count() == doc["pairs"]


def test_one_run_at_a_time(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "db"))
    e.init()
    (tmp_path / "db/LOCK").write_text("another")
    with pytest.raises(RuntimeError):
        e.report()
    os.utime(tmp_path / "db/LOCK", (1, 1))
    assert e.report()["pairs"] > 0 and not (tmp_path / "db/LOCK").exists()


def test_a_crashed_write_leaves_the_version_before(spark, tmp_path):
    from simweave.sources.store import Store

    s = Store(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([("a", n, 1.0)], "file_path string, checksum string, mtime double")
    s.replace("files", row("1"))
    reader = s.read("files")
    s.replace("files", row("2"))
    assert reader.first()["checksum"] == "1"  # still there for those who read it
    (tmp_path / "files/at-3").write_text("")
    assert s.read("files").first()["checksum"] == "2"
    s.replace("files", row("3"))
    s.replace("files", row("4"))
    assert s.read("files").first()["checksum"] == "4" and len(list((tmp_path / "files").glob("at-*"))) == 2


def test_embedding_source(spark, tree, monkeypatch):
    from simweave.functions import embed

    config.save(str(tree), replace(config.load(str(tree)), embeddingSource="mine"))
    with pytest.raises(ValueError):
        Engine(spark, str(tree)).init()
    monkeypatch.setitem(embed.VECTORIZERS, "mine", lambda code: F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    e = Engine(spark, str(tree))
    e.init()
    assert {tuple(r["embedding"]) for r in e.store.read("units").collect()} == {(1.0, 2.0)}
    with pytest.raises(ValueError):
        embed.vectorizer("")
    assert embed.service("HTTP://x:1/") == "HTTP://x:1" and embed.service("ollama") == embed.LOCAL and embed.service("other") is None
    assert embed.answerer("hashed") is None and embed.answerer("https://x:1/path") is not None


def test_model_service(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from simweave.functions import embed

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/chat" and "fail" in body["messages"][0]["content"]:
                self.send_error(500)
                return
            found = {"embeddings": [[float(len(body["input"])), 1.0]]} if self.path == "/api/embed" else {"message": {"content": f" yes {body['options']['num_predict']} "}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([("abc",), ("fail",), (None,)], "t string")
    got = rows.select("t", embed.vectorizer(base)(F.col("t")).alias("v"), embed.answerer(base + "/x")(F.coalesce("t", F.lit("?"))).alias("a")).collect()
    assert {r["t"]: (r["v"], r["a"]) for r in got} == {"abc": ([3.0, 1.0], "yes 32"), "fail": ([4.0, 1.0], None), None: (None, "yes 32")}
    server.shutdown()


def test_nothing_to_compare(spark, tmp_path):
    doc = Engine(spark, str(tmp_path)).report()
    assert doc["duplicates"] == [] and "metrics" not in doc and doc["grade"] == "Excellent"


def test_own_language_and_kernel(spark, tmp_path, monkeypatch):
    from simweave.operators.similarity import similar_pairs_by_expression
    from simweave.sources import files

    monkeypatch.setitem(files.EXTRACTORS, ".toy", None)
    monkeypatch.setitem(files.LABELS, ".toy", None)

    def units(path, text, least, least_block):
        return [{"id": f"function:{path}:{i}-{i}", "name": line.split()[0], "file_path": path, "start_line": i, "end_line": i, "code": line, "unit_type": "function", "parent_id": None} for i, line in enumerate(text.split("\n")) if line]

    files.register_extractor(".toy", units, lambda kind, name, path, code: F.when(name == "f", F.concat(F.lit("toy-"), name)).otherwise(F.lit("")))
    (tmp_path / "a.toy").write_text("f one two three\ng one two three\nh other words here\n")
    e = Engine(spark, str(tmp_path), kernel=similar_pairs_by_expression)
    e.init()
    doc = e.report()
    assert [p["exclusion"] for p in doc["duplicates"]] == ["function|g(arity:0)|toy-f"] or doc["duplicates"] == []
    low = {r["left_id"] for r in similar_pairs_by_expression(e.store.read("units"), {"function": 0.5}).collect()}
    assert low


def test_command_line(spark, tree, capsys):
    assert main(["init", str(tree)]) == 0
    assert main(["dupes", str(tree), "--json"]) == 0
    assert '"duplicates"' in capsys.readouterr().out
    assert main(["dupes", str(tree), "--html", str(tree / "r.html")]) == 0 and (tree / "r.html").read_text().startswith("<!doctype")
    assert main(["dupes", str(tree), "--ui", "--no-llm", "--save", str(tree / "saved")]) == 0
    shown = capsys.readouterr().out.strip().splitlines()[-1]
    assert shown.endswith("report.html") and open(shown).read().startswith("<!doctype") and list((tree / "saved").glob("dupes-*.json"))
    assert main(["exclude", "zzz", str(tree)]) == 1
    assert main(["clean", str(tree)]) == 0
    assert main(["update", str(tree)]) == 0
