import pytest

from simweave.sources import config, files, java
from simweave.sources.store import Store

SAMPLE = """package a;
import java.util.*;

/** Doc with { brace. */
public class Sample<T extends List<String>> {
  private final int[] values = { 1, 2, 3 };
  String s = "}{ // not code";

  public Sample(int a) {
    if (a > 0) {
      int x = 1;
      x++;
      x++;
      x++;
      x++;
    }
    this.a = a;
  }

  @Override
  public int sum(int a, int... more) { // trailing
    switch (a) {
      case 1:
        break;
      default:
        return 0;
    }
    for (int i = 0; i < a; i++) {
      a += i; /* one
      two */
      a -= 1;
      a *= 2;
      a /= 2;
      a += 0;
    }
    Runnable r = new Runnable() {
      public void run() {
        go();
        go();
        go();
      }
    };
    return a;
  }

  public int getValue() {
    return 1;

  }

  public int getById(long id) {
    int q = 0;
    return q;
  }
}

class Dto {
  private int a;
  public int getA() { return a; }
  public void setA(int a) { this.a = a; }
}

interface Shape { double area(); }
"""


def test_extract():
    units = {(u["unit_type"], u["name"], u["start_line"]): u for u in java.extract("src/Sample.java", SAMPLE)}
    kinds = lambda k: sorted(n for t, n, _ in units if t == k)
    assert kinds("class") == ["Sample"]
    assert kinds("function") == ["Sample.Sample", "Sample.getById", "Sample.run", "Sample.sum"]
    blocks = sorted((n, s) for t, n, s in units if t == "block")
    assert ("Sample.Sample", 9) in blocks and ("Sample.sum", 20) in blocks and ("Sample.sum", 27) in blocks
    assert ("Sample.Sample", 8) not in blocks
    whole = next(u for (t, _, _), u in units.items() if t == "class")
    assert whole["code"].count(" { }") == 4 and "go()" not in whole["code"] and whole["parent_id"] is None
    body = units[("function", "Sample.sum", 19)]
    assert "trailing" not in body["code"] and "two */" not in body["code"] and body["parent_id"] == whole["id"]
    assert whole["id"] == f"class:src/Sample:4-{whole['end_line']}"


def test_limits_and_errors():
    assert java.extract("A.java", "  \n") == []
    assert java.extract("A.java", "class A { void f() {") != None  # noqa: E711
    short = "class A {\n void f() { }\n void longer() {\n  a();\n  b();\n  c();\n }\n}"
    names = lambda n: [u["name"] for u in java.extract("A.java", short, n) if u["unit_type"] == "function"]
    assert names(3) == ["A.longer"] and names(0) == ["A.f", "A.longer"]
    assert [u["name"] for u in java.extract("A.java", "class A {\n void longer() {\n  a();\n  b();\n  c();\n }\n}", 6)] == ["A"]


def test_files_and_rules(spark, tmp_path):
    for name, text in {"src/A.java": SAMPLE, "src/B.txt": "x", "build/C.java": SAMPLE, "src/gen/D.java": SAMPLE, "src/gen/Keep.java": SAMPLE, ".git/E.java": SAMPLE, "F.JAVA": SAMPLE}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("# no\n/build\n\n")
    (tmp_path / "src/.gitignore").write_text("gen/*\n!gen/Keep.java\n")
    found = files.list_files(spark, str(tmp_path), ["F.*"])
    assert sorted(r["file_path"] for r in found.collect()) == ["src/A.java", "src/gen/Keep.java"]
    units = files.extract_units(found, context=50)
    assert {r["unit_type"] for r in units.collect()} == {"class", "function", "block"}
    chunks = [r for r in units.collect() if ":chunk" in r["id"]]
    assert chunks and max(len(r["code"]) for r in chunks) <= 50
    assert [r["file_path"] for r in files.list_files(spark, str(tmp_path / "src/A.java")).collect()] == ["A.java"]
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))


def test_names_bytes_and_nesting_of_a_real_tree(spark, tmp_path):
    for name in ("_gen/A.java", "ok/_C.java", "ok/deep/er/D.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(SAMPLE)
    (tmp_path / "ok/Latin.java").write_bytes("class L {\n void f() {\n  a(\"é\");\n  b();\n  c();\n }\n}".encode("latin-1"))
    (tmp_path / "ok/Nest.java").write_text("class N {\n void f() {\n" + "{\n" * 2000 + "}\n" * 2000 + " }\n}")
    (tmp_path / "ok/Lock.java").write_text("class X {}")
    (tmp_path / "ok/Gone.java").symlink_to(tmp_path / "nowhere")
    found = files.list_files(spark, str(tmp_path))
    assert sorted(r["file_path"] for r in found.collect()) == ["_gen/A.java", "ok/Latin.java", "ok/Lock.java", "ok/Nest.java", "ok/_C.java", "ok/deep/er/D.java"]
    units = files.extract_units(found).collect()
    assert {r["file_path"] for r in units if r["unit_type"] == "function"} >= {"ok/Latin.java", "ok/Nest.java", "_gen/A.java"}
    assert sum(r["file_path"] == "ok/Nest.java" and r["unit_type"] == "block" for r in units) > 1900
    some = spark.createDataFrame([("ok/_C.java",), ("ok/none.java",)], "file_path string")
    assert [r["file_path"] for r in files.listing(spark, str(tmp_path), paths=some).collect()] == ["ok/_C.java"]


def test_rules_of_the_folders_above_some_paths(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for n in ("a/b/X.java", "a/b/Y.java", "a/Z.java"):
        (tmp_path / n).write_text("class A {}")
    (tmp_path / "a/.gitignore").write_text("b/*\n")
    (tmp_path / "a/b/.gitignore").write_text("!Y.java\n")
    paths = spark.createDataFrame([("a/b/X.java",), ("a/b/Y.java",), ("a/Z.java",)], "file_path string")
    want = ["a/Z.java", "a/b/Y.java"]
    assert sorted(r["file_path"] for r in files.listing(spark, str(tmp_path), paths=paths).collect()) == want == sorted(r["file_path"] for r in files.listing(spark, str(tmp_path)).collect())


def test_a_file_on_which_its_extractor_fails_has_no_units(spark, monkeypatch):
    def fails(path, text, least, least_block):
        raise ValueError(path)

    monkeypatch.setitem(files.EXTRACTORS, ".bad", fails)
    rows = spark.createDataFrame([("x.bad", "x"), ("src/Sample.java", SAMPLE)], "file_path string, text string")
    assert {r["file_path"] for r in files.extract_units(rows).collect()} == {"src/Sample.java"}


def test_chunks_add_up(spark, tmp_path):
    text = "class A {\n void f() {\n" + "".join(f"  call{i}();\n" for i in range(60)) + " }\n}"
    rows = spark.createDataFrame([("A.java", text)], "file_path string, text string")
    whole = [r for r in files.extract_units(rows).collect() if r["unit_type"] == "block"]
    cut = sorted((r for r in files.extract_units(rows, context=50).collect() if r["unit_type"] == "block"), key=lambda r: int(r["id"].split("chunk")[1]))
    assert "".join(r["code"] for r in cut) == whole[0]["code"] and {r["parent_id"] for r in cut} == {whole[0]["parent_id"]}


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    assert config.ensure(str(tmp_path)) and not config.ensure(str(tmp_path)) and not config.ensure(str(tmp_path / "no"))
    (tmp_path / config.FILE).write_text('{"threshold": 0.5, "other": 1}')
    assert config.load(str(tmp_path)).threshold == 0.5
    (tmp_path / config.FILE).write_text('{"threshold": "x"}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path))
    (tmp_path / config.FILE).write_text("{")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    assert s.read("files").count() == 0
    ddl = "file_path string, checksum string, mtime double"
    s.upsert("files", spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0)], ddl))
    s.upsert("files", spark.createDataFrame([("b", "2", 2.0), ("c", "1", 1.0)], ddl))
    assert sorted((r["file_path"], r["checksum"]) for r in s.read("files").collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    s.delete_paths("files", spark.createDataFrame([("a",)], "file_path string"))
    assert s.get("files", "a").count() == 0 and s.get("files", "b").count() == 1
    v = "pair_key string, verdict string, left_file string, right_file string, created_at long"
    s.upsert("verdicts", spark.createDataFrame([("k", "no", "a", "b", 1), ("l", "no", "c", "d", 1)], v))
    s.delete_paths("verdicts", spark.createDataFrame([("d",)], "file_path string"))
    assert [r["pair_key"] for r in s.read("verdicts").collect()] == ["k"]
