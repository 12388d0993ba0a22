"""Source files as tables: listing, ignore rules, contents, extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.functions.labels import unit_label
from simweave.functions.text import relative_path, supported
from simweave.operators.units import UNIT_DDL, split_long
from simweave.scratch import materialize
from simweave.sources import java
from simweave.sources.fs import kind, open_fs

#: Always ignored: fixed values.
DEFAULT_IGNORES = [".git/**", ".dry/**"]

Extractor = Callable[[str, str, int, int], list[dict]]
#: Extractors by file suffix; the first that fits is used.
EXTRACTORS: dict[str, Extractor] = {".java": java.extract}


#: Labels by file suffix, as functions of the columns of type, name, path and code; where one gives null or nothing, the usual label stands.
LABELS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {}


def register_extractor(suffix: str, extractor: Extractor, label: Callable[[Column, Column, Column, Column], Column] | None = None) -> None:
    EXTRACTORS[suffix] = extractor
    if label:
        LABELS[suffix] = label


def label_of(unit_type: Column, name: Column, path: Column, code: Column) -> Column:
    usual = unit_label(unit_type, name, path, code)
    own = [F.when(supported(path, (suffix,)), F.nullif(label(unit_type, name, path, code), F.lit(""))) for suffix, label in LABELS.items()]
    return F.coalesce(*own, usual)


#: Folders that are never entered: fixed values.
CLOSED = (".git", ".dry")
LISTED = "path string, folder boolean, mtime double"
BATCH_BYTES = 8 << 20


def _list(root: str):
    """(folder) -> LISTED: what lies in each folder; a folder that cannot be read is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/")))
                except OSError:
                    found = []
                found = [i for i in found if i.type == pafs.FileType.File or (i.type == pafs.FileType.Directory and i.base_name not in CLOSED)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{i.base_name}".lstrip("/") for i in found], pa.string()), pa.array([i.type == pafs.FileType.Directory for i in found], pa.bool_()), pa.array([(i.mtime_ns or 0) / 1e6 for i in found], pa.float64())], names=["path", "folder", "mtime"])

    return run


def _stat(root: str):
    """(path) -> LISTED: those that are files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for batch in batches:
            infos = [(p, fs.get_file_info(f"{base}/{p}")) for p in batch.column(0).to_pylist()]
            infos = [(p, i) for p, i in infos if i.type == pafs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in infos], pa.string()), pa.array([False] * len(infos), pa.bool_()), pa.array([(i.mtime_ns or 0) / 1e6 for _, i in infos], pa.float64())], names=["path", "folder", "mtime"])

    return run


def _texts(root: str):
    """(path) -> (path, text): each file's text, malformed bytes replaced; a file that is gone or cannot be read is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        paths, texts, size = [], [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with fs.open_input_file(f"{base}/{path}") as f:
                        data = f.read()
                except OSError:
                    continue
                paths.append(path)
                texts.append(data.decode("utf-8", "replace"))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield batch_of()
                    paths, texts, size = [], [], 0
        yield batch_of()

    return run


def _spread(rows: DataFrame, each: int = 64) -> DataFrame:
    """Names are few bytes and much work: so many of them a task."""
    return rows.repartition(max(1, min(10_000, -(-rows.count() // each))))


def _root(spark: SparkSession, base: str) -> tuple[str, bool]:
    """(root, whether it is a single file); raises FileNotFoundError."""
    fs, path = open_fs(base)
    found = kind(fs, path)
    if found == pafs.FileType.NotFound:
        raise FileNotFoundError(f"Path not found: {base}")
    return (base if "://" in base else f"file://{path}").rstrip("/"), found == pafs.FileType.File


def walk(spark: SparkSession, root: str) -> DataFrame:
    """LISTED of everything below ``root``, level by level: each level's folders are listed in parallel."""
    todo = spark.createDataFrame([("",)], "folder string")
    levels = []
    while True:
        levels.append(materialize(_spread(todo).mapInArrow(_list(root), LISTED), "listing"))
        todo = levels[-1].where("folder").select(F.col("path").alias("folder"))
        if todo.isEmpty():
            return reduce(DataFrame.unionAll, levels)


def listing(spark: SparkSession, base: str, ignores: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """(file_path, mtime) of supported files below ``base``, or of ``base`` itself; hidden ones and ignored ones are left out.

    With ``paths`` (file_path, relative) only those are looked at, and only the
    rules of the folders above them. A missing ``base`` raises FileNotFoundError.
    """
    root, single = _root(spark, base)
    if single:
        root, _, name = root.rpartition("/")
        paths, rules = spark.createDataFrame([(name,)], "file_path string"), []
    if paths is None:
        found = walk(spark, root)
        rules = [] if single else ignore_rules(spark, root, found.where(~F.col("folder")).select("path"))
    else:
        found = materialize(_spread(paths.select("file_path").distinct()).mapInArrow(_stat(root), LISTED), "listing")
        if not single:
            parts = F.split("file_path", "/")
            above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.concat(F.slice(parts, 1, n), F.array(F.lit(".gitignore"))), "/"))
            rules = ignore_rules(spark, root, paths.select(F.explode(above).alias("path")).distinct())
    path = F.col("path")
    rows = found.where(~F.col("folder") & supported(path, tuple(EXTRACTORS)) & ~path.rlike(r"(^|/)\."))
    return rows.where(~ignored(path, DEFAULT_IGNORES + rules + (ignores or []))).select(relative_path(path).alias("file_path"), "mtime")


def contents(spark: SparkSession, base: str, files: DataFrame) -> DataFrame:
    """``files`` (file_path, mtime) -> (file_path, checksum, mtime, text): only these are opened. Malformed UTF-8 is replaced; what cannot be read is left out."""
    root, single = _root(spark, base)
    root = root.rpartition("/")[0] if single else root
    read = _spread(files.select("file_path")).mapInArrow(_texts(root), "file_path string, text string")
    return read.join(files.select("file_path", "mtime"), "file_path").select("file_path", F.md5("text").alias("checksum"), "mtime", "text")


def list_files(spark: SparkSession, base: str, ignores: list[str] | None = None) -> DataFrame:
    """:func:`contents` of the whole :func:`listing`."""
    return contents(spark, base, materialize(listing(spark, base, ignores), "files"))


def ignore_rules(spark: SparkSession, root: str, paths: DataFrame) -> list[str]:
    """Rules of the ignore files among ``paths`` (path), scoped to their folders; a folder's come before those below it."""
    names = paths.where(F.col("path").rlike(r"(^|/)\.gitignore$"))
    texts = _spread(materialize(names, "ignore")).mapInArrow(_texts(root), "path string, text string").collect()
    out = []
    for r in sorted(texts, key=lambda r: r["path"].split("/")[:-1]):
        folder = r["path"].rpartition("/")[0]
        out += [rule for line in r["text"].split("\n") if (rule := scoped_rule(line, folder))]
    return out


def scoped_rule(line: str, folder: str) -> str | None:
    """A line of an ignore file as a rule for the root: blanks and comments are none; a leading slash goes, also at the root; below a folder the rule is put under it, without a trailing slash."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("/")
    if not rule:
        return None
    if folder:
        rule = f"{folder}/{rule}".rstrip("/")
    return ("!" if negated else "") + rule


def ignore_regex(rule: str) -> str:
    """One rule (without ``!``) as a regular expression over relative paths of files: a match covers a file or a folder above it."""
    anchored = "/" in rule.rstrip("/")
    folder = rule.endswith("/")
    body, i, rule = "", 0, rule.strip("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            body, i = body + "/.*", i + 3
        elif rule[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif rule[i] == "?":
            body, i = body + "[^/]", i + 1
        elif rule[i] == "[" and (j := rule.find("]", i + 2)) > 0:
            inner = rule[i + 1 : j]
            body, i = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        else:
            body, i = body + re.sub(r"([^\w/ -])", r"\\\1", rule[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that matches decides; ``!`` readmits."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(ignore_regex(r.removeprefix("!"))), F.lit(not r.startswith("!"))).otherwise(out)
    return out


def extract_units(files: DataFrame, min_lines: int = 3, min_block_lines: int = 5, context: int | None = None) -> DataFrame:
    """``files`` (file_path, text) -> units, file by file in parallel; over-long blocks are cut into chunks of ``context`` characters. A file on which its extractor fails has no units."""
    fields = [f for f in UNIT_DDL.split(", ") if not f.startswith("embedding")]
    schema = pa.schema([(f.split()[0], pa.int32() if f.split()[1] == "int" else pa.string()) for f in fields])
    found = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                use = next((e for s, e in found.items() if path.lower().endswith(s)), None)
                try:
                    rows = use(path, text or "", min_lines, min_block_lines) if use else []
                except Exception:  # one odd file is not the scan's end
                    rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    units = files.select("file_path", "text").mapInArrow(run, ", ".join(fields))
    if context:
        blocks = split_long(units.where(F.col("unit_type") == "block"), context)
        units = units.where(F.col("unit_type") != "block").unionByName(blocks)
    return units.withColumn("embedding", F.lit(None).cast("array<float>"))
