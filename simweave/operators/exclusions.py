"""Excluded paths and excluded pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.functions.labels import parse_pair_key
from simweave.functions.text import glob_regex, matches_glob


def purge_set(units: DataFrame, files: DataFrame, globs: list[str]) -> DataFrame:
    """Distinct paths of units or files that a glob excludes."""
    paths = units.select("file_path").unionAll(files.select("file_path")).where(matches_glob(F.col("file_path"), globs))
    return paths.distinct()


def parsed_exclusions(keys: DataFrame) -> DataFrame:
    """(key) -> (key, type, left, right); malformed keys have null parts."""
    return keys.select("key", parse_pair_key(F.col("key")).alias("p")).select("key", "p.type", "p.left", "p.right")


def exclude_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (unit_type, left_label, right_label, ...) that no key excludes.

    Functions and blocks match by equal labels in either order: an anti-join.
    Classes match by globs, straight or swapped. Malformed keys match nothing.
    """
    spark = pairs.sparkSession
    entries = [(k, *k.split("|")) for k in keys if k.count("|") == 2 and k.split("|")[0] in ("class", "function", "block")]
    exact = [(t, min(a, b), max(a, b)) for _, t, a, b in entries if t != "class"]
    globs = [(a, b) for _, t, a, b in entries if t == "class"]
    out = pairs
    if exact:
        named = spark.createDataFrame(sorted(set(exact)), "unit_type string, lo string, hi string")
        out = out.withColumn("lo", F.least("left_label", "right_label")).withColumn("hi", F.greatest("left_label", "right_label")).join(named, ["unit_type", "lo", "hi"], "left_anti").select(*pairs.columns)
    hit = F.lit(False)
    for a, b in globs:
        l, r, x, y = F.col("left_label"), F.col("right_label"), glob_regex(a), glob_regex(b)
        hit = hit | (l.rlike(x) & r.rlike(y)) | (l.rlike(y) & r.rlike(x))
    return out.where((F.col("unit_type") != "class") | ~F.coalesce(hit, F.lit(False)))


def clean_exclusions(keys: list[str], labels: DataFrame) -> tuple[list[str], list[str]]:
    """(kept, removed): a key stays while some pair of units (unit_type, label: a row a unit) still matches it.

    No pairs are formed: an exact key needs both labels (two units if they are
    equal); a class key needs units on both globs that are not one single unit.
    """
    spark = labels.sparkSession
    entries = [(k, *k.split("|")) for k in keys if k.count("|") == 2 and k.split("|")[0] in ("class", "function", "block")]
    exact = [e for e in entries if e[1] != "class"]
    kept: set[str] = set()
    if exact:
        wanted = spark.createDataFrame([(k, t, x) for k, t, a, b in exact for x in {a, b}], "key string, unit_type string, label string")
        counts = {(r["key"], r["label"]): r["n"] for r in labels.join(F.broadcast(wanted), ["unit_type", "label"]).groupBy("key", "label").agg(F.count("*").alias("n")).collect()}
        kept |= {k for k, _, a, b in exact if (counts.get((k, a), 0) >= 2 if a == b else counts.get((k, a), 0) and counts.get((k, b), 0))}
    globs = [e for e in entries if e[1] == "class"]
    if globs:
        c = F.col("label")
        row = labels.where(F.col("unit_type") == "class").agg(*[F.count_if(test).alias(f"{n}{i}") for i, (_, _, a, b) in enumerate(globs) for n, test in (("a", c.rlike(glob_regex(a))), ("b", c.rlike(glob_regex(b))), ("u", c.rlike(glob_regex(a)) | c.rlike(glob_regex(b))))]).first()
        kept |= {e[0] for i, e in enumerate(globs) if row[f"a{i}"] and row[f"b{i}"] and row[f"u{i}"] > 1}
    return [k for k in keys if k in kept], [k for k in keys if k not in kept]


def add_exclusion(keys: list[str], key: str) -> list[str]:
    return keys if key in keys else [*keys, key]
