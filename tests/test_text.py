import pytest
from pyspark.sql import functions as F

from simweave.functions import embed, labels, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("code", "n"), [("void f(int a, int b) {", 2), ("f()", 0), ("no parentheses", 0), ("{ f(a) }", 0), ('@G("/a") f(int a, int b)', 1), ("f( a ,, b )", 2), ("", 0)])
def test_arity(spark, code, n):
    assert one(spark, text.arity(F.lit(code))) == n


def test_normalised_blocks_agree(spark):
    h = lambda c: one(spark, labels.unit_label(F.lit("block"), F.lit("n"), F.lit("p"), F.lit(c)))
    assert h("{ a + b; } // x") == h("{\n/* y\n z */ a+b ;}")
    assert h("a - b") != h("a + b")
    assert len(h("a")) == 40


def test_labels_and_keys(spark):
    assert one(spark, labels.unit_label(F.lit("function"), F.lit("Foo.bar"), F.lit("src/Foo.java"), F.lit("bar(int a, int b) {}"))) == "Foo.bar(arity:2)"
    assert one(spark, labels.pair_key(F.lit("class"), F.lit("src/b/B.java"), F.lit("src/a/A.java"))) == "class|src/a/A.java|src/b/B.java"
    p = one(spark, labels.parse_pair_key(F.lit("block|z|a")))
    assert (p["type"], p["left"], p["right"], p["key"]) == ("block", "a", "z", "block|a|z")
    for bad in ("a|b", "BLOCK|a|b", "block|a|b|c", ""):
        assert one(spark, labels.parse_pair_key(F.lit(bad))) is None


@pytest.mark.parametrize(("kind", "name", "path", "want"), [("class", "A", "s\\A.java", "class:s/A:1-2"), ("function", "A", "s/A.java", "function:s/A:1-2"), ("function", "A.run", "s/A.java", "function:s/A.run:1-2"), ("function", "B.run", "s/A.java", "function:s/A.B.run:1-2"), ("block", "Ab", "A", "block:A.Ab:1-2")])
def test_ids(spark, kind, name, path, want):
    assert one(spark, labels.unit_id(F.lit(kind), F.lit(name), F.lit(path), F.lit(1), F.lit(2))) == want


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/test/**", "a/test/b.java", True), ("**/test/**", "test/b", True), ("**/test/**", "a/testing/b", False), ("src/*.java", "src/a.java", True), ("src/*.java", "src/x/a.java", False), ("src/**", "src/.h/a", True), ("a?c", "abc", True), ("{a,b*}.x", "bcd.x", True), ("[!a]x", "bx", True), ("a.b", "axb", False), ("src/{a,{b,c*}/d}.java", "src/cc/d.java", True), ("{a,{b,c}}x", "cx", True), ("{a,{b,c}}x", "ax}", False), ("{a", "{a", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, text.matches_glob(F.lit(path), [glob])) is hit


def test_vectorizer(spark):
    v = one(spark, embed.hashed_terms(F.lit("a b A"), 8))
    assert sum(v) == 3 and max(v) >= 2
    with pytest.raises(ValueError):
        embed.vectorizer("")
    with pytest.raises(ValueError):
        embed.vectorizer("http://nowhere")
