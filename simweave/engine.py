"""The library's four verbs over a source tree: init, update, report, clean."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from simweave.functions.embed import answerer, vectorizer
from simweave.functions.labels import pair_key, short_id
from simweave.operators import exclusions, incremental, pairs, score, verdicts
from simweave.operators.similarity import similar_pairs
from simweave.operators.units import within_context
from simweave.plans import report
from simweave.plans.report import PAGE
from simweave.scratch import materialize
from simweave.shipping import ship
from simweave.sources import config as cfg
from simweave.sources.files import contents, extract_units, label_of, list_files, listing
from simweave.sources.fs import write_text
from simweave.sources.store import Store
from simweave.streaming.edits import real_edits, refresh_on_edits

Ask = Callable[[Column], Column]


def relative_parts(path: str) -> list[str]:
    """The parts of a relative path that stays below its root."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if path.startswith(("/", "\\")) or ".." in parts or ":" in path:
        raise ValueError(f"not a path of the tree: {path}")
    return parts


class Engine:
    """``tree`` is the folder of sources, ``store`` the folder of tables.

    ``vectorize`` maps a column of code to vectors; without it the
    configuration's embeddingSource says how. ``ask`` maps a column of prompts
    to answers (null for a failed call); without it the service that
    embeddingSource names is asked, and if it names none no pair is judged.
    ``kernel`` finds the pairs of one type, as :func:`similar_pairs` does.
    """

    def __init__(self, spark: SparkSession, tree: str, store: str | None = None, vectorize: Ask | None = None, ask: Ask | None = None, ancestor_depth: int = 1, kernel: Callable[..., DataFrame] = similar_pairs):
        self.spark, self.tree, self.vectorize, self.ask, self.depth, self.kernel = spark, tree.rstrip("/"), vectorize, ask, ancestor_depth, kernel
        self.store = Store(spark, store or f"{self.tree}/.dry")
        ship(spark)

    def config(self) -> cfg.Config:
        return cfg.load(self.tree)

    def _extract(self, files: DataFrame, c: cfg.Config) -> DataFrame:
        units = extract_units(files, int(c.minLines), int(c.minBlockLines), int(c.contextLength))
        return units.withColumn("embedding", within_context(F.col("code"), (self.vectorize or vectorizer(c.embeddingSource))(F.col("code")), int(c.contextLength)))

    def _files(self, c: cfg.Config) -> DataFrame:
        return list_files(self.spark, self.tree, list(c.excludedPaths))

    def init(self, skip_embeddings: bool = False) -> None:
        """Index everything anew."""
        cfg.ensure(self.tree)
        c = self.config()
        files = materialize(self._files(c), "files")  # each file is opened once
        units = self._extract(files, c)
        if skip_embeddings:
            units = units.withColumn("embedding", F.lit(None).cast("array<float>"))
        self.store.replace("units", units)
        self.store.replace("files", files.select("file_path", "checksum", "mtime"))
        self._purge(c)

    def _purge(self, c: cfg.Config) -> None:
        gone = exclusions.purge_set(self.store.read("units"), self.store.read("files"), list(c.excludedPaths))
        if not gone.isEmpty():
            gone = materialize(gone, "purge")
            self.store.delete_paths("units", gone)
            self.store.delete_paths("files", gone)

    def update(self, paths: DataFrame | None = None) -> DataFrame:
        """Bring the index up to date; returns the dirty paths (file_path).

        With ``paths`` (file_path, relative) only these are looked at, not the
        whole tree. Files whose time is that of the last run are not opened.
        """
        c = self.config()
        known = self.store.read("files")
        if paths is not None:
            paths = materialize(paths.select("file_path").distinct(), "paths")
            known = known.join(paths, "file_path", "left_semi")
        found = materialize(listing(self.spark, self.tree, list(c.excludedPaths), paths), "found")
        same = found.join(known, ["file_path", "mtime"], "left_semi")
        fresh = materialize(contents(self.spark, self.tree, found.join(same.select("file_path"), "file_path", "left_anti")), "fresh")
        current = fresh.select("file_path", "checksum", "mtime").unionByName(known.join(same, "file_path", "left_semi"))
        diff = materialize(incremental.snapshot_diff(current, known), "diff")
        dirty = incremental.dirty_paths(diff)
        if dirty.isEmpty():
            return dirty
        changed = fresh.join(diff.where(F.col("status").isin("added", "changed")), "file_path", "left_semi")
        units = materialize(self._extract(changed, c), "units")
        kept = incremental.delete_by(self.store.read("units"), dirty, "file_path")
        self.store.replace("units", kept.unionByName(units.select(kept.columns)))
        known = incremental.delete_by(self.store.read("files"), dirty, "file_path")
        self.store.replace("files", known.unionByName(changed.select("file_path", "checksum", "mtime")))
        self._purge(c)
        return dirty

    def watch(self, events: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        """Update the index by a stream of edits (file_path, ts, changes) below the tree; see :func:`refresh_on_edits`."""
        below = real_edits(events, self.tree).withColumn("file_path", F.substr("file_path", F.lit(len(self.tree) + 2)))

        def refresh(paths: DataFrame) -> None:
            with self.store.alone():
                self.update(paths)

        return refresh_on_edits(below, refresh, checkpoint, **options)

    def _labelled(self, found: DataFrame, units: DataFrame) -> DataFrame:
        side = lambda s: units.select(F.col("id").alias(f"{s}_id"), F.col("file_path").alias(f"{s}_file"), label_of(F.col("unit_type"), F.col("name"), F.col("file_path"), F.col("code")).alias(f"{s}_label"))
        both = found.join(side("left"), "left_id").join(side("right"), "right_id")
        return both.withColumn("pair_key", pair_key(F.col("unit_type"), F.col("left_label"), F.col("right_label")))

    def _prompt(self, found: DataFrame, units: DataFrame) -> DataFrame:
        """Adds ``prompt``: both units and the files they are in (missing: empty)."""
        named = found.select(F.col("left_file").alias("file_path")).unionAll(found.select(F.col("right_file").alias("file_path"))).distinct()
        texts = contents(self.spark, self.tree, materialize(self.store.read("files").join(named, "file_path", "left_semi").select("file_path", "mtime"), "named")).select("file_path", "text")
        return verdicts.prompted(found, units, texts)

    def report(self, full: bool = False, at: datetime | None = None, judge: bool = True) -> dict:
        """Update, find pairs, filter them (without ``judge`` by exclusions only), score, save; returns the report with its best pairs.

        All pairs are in the table of :meth:`findings`. One run at a time. Pairs between clean files come from the last run if its threshold is
        the same and not ``full``; only pairs with a dirty side are computed.
        """
        with self.store.alone():
            return self._report(full, at, judge)

    def _report(self, full: bool, at: datetime | None, judge: bool) -> dict:
        began = time.perf_counter()
        dirty = materialize(self.update(), "dirty")
        indexed = time.perf_counter()
        c, at = self.config(), at or datetime.now(UTC)
        units = self.store.read("units")
        last = report.latest(self.store.read("reports")).select("threshold").first()
        enough = units.limit(2).count() == 2
        if not enough:
            found = self.spark.createDataFrame([], "left_id string, right_id string, unit_type string, similarity double")
        elif last is not None and last["threshold"] == c.threshold and not full:
            reused = incremental.reusable_pairs(self.store.read("pairs"), units, dirty).select("left_id", "right_id", "unit_type", "similarity")
            if dirty.isEmpty():
                found = reused
            else:
                touched = units.join(dirty, "file_path", "left_semi").select("id")
                new = pairs.weighted_pairs(units, c.threshold, touched, self.depth, self.kernel).select(reused.columns)
                found = incremental.merge_pairs(reused, new)
        else:
            found = pairs.weighted_pairs(units, c.threshold, None, self.depth, self.kernel).select("left_id", "right_id", "unit_type", "similarity")
        found = materialize(exclusions.exclude_pairs(self._labelled(found, units), list(c.excludedPairs)), "pairs")
        kept, judging = found, time.perf_counter()
        ask = self.ask or answerer(c.embeddingSource)
        if judge and c.enableLLMFilter and ask is not None:
            self.store.delete_paths("verdicts", dirty)
            asked = self._prompt(found, units)
            done, new = verdicts.classify(asked, self.store.read("verdicts"), dirty, ask, F.col("prompt"))
            done = materialize(done.drop("prompt"), "judged")
            self.store.upsert("verdicts", done.where(F.col("verdict").isNotNull()).join(new.select("pair_key"), "pair_key", "left_semi").select("pair_key", "verdict", "left_file", "right_file", F.lit(int(at.timestamp() * 1000)).alias("created_at")))
            kept = verdicts.keep_true(done).drop("verdict")
        kept = materialize(kept.select(found.columns), "kept")
        judged = time.perf_counter()
        members = materialize(pairs.with_members(kept, units).withColumn("short_id", short_id(F.col("id"))).join(kept.select(F.concat_ws("::", "left_id", "right_id").alias("id"), F.col("pair_key").alias("exclusion")), "id", "left"), "members")
        s = materialize(score.duplication_score(members, units), "score")
        metrics = score.scan_metrics(units, self.store.read("files"), found, kept) if enough else None
        doc = report.document(members, s, c.threshold, at, metrics)
        if metrics is not None:
            now = time.perf_counter()
            doc["metrics"]["seconds"] = {"index": indexed - began, "detect": judging - indexed + now - judged, "judge": judged - judging, "total": now - began}
        row = s.first()
        run = uuid.uuid4().hex
        self.store.replace("pairs", kept)
        self.store.replace("findings", members.withColumn("run_id", F.lit(run)))
        self.store.upsert("reports", self.spark.createDataFrame([(run, at, float(c.threshold), row["grade"], float(row["score"]), json.dumps(doc, ensure_ascii=False))], "run_id string, generated_at timestamp, threshold double, grade string, score double, document string"))
        return doc

    def latest_report(self) -> dict | None:
        row = report.latest(self.store.read("reports")).first()
        return None if row is None else json.loads(row["document"])

    def findings(self) -> DataFrame:
        """All pairs of the latest report, both sides with their code."""
        last = report.latest(self.store.read("reports")).select("run_id")
        return self.store.read("findings").join(last, "run_id", "left_semi").drop("run_id")

    def page(self, offset: int = 0, limit: int = PAGE) -> dict:
        """A page of the latest report's pairs, with the number of all."""
        return report.counted_page(self.findings(), offset, limit)

    def save(self, folder: str | None = None) -> str | None:
        """Write the latest report as JSON below ``folder`` (by default the store's ``reports-json``): its head in a file, all pairs as JSON lines beside it. Returns the file's path, None without a report."""
        doc = self.latest_report()
        if doc is None:
            return None
        path = f"{folder or self.store.root + '/reports-json'}/{report.file_name(datetime.fromisoformat(doc['generatedAt']))}"
        report.write_json(self.findings(), path.removesuffix(".json") + ".pairs")
        write_text(path, report.as_json(doc))
        return path

    def source(self, file_path: str) -> str:
        """The text of a file of the tree; a path that leads out of it raises ValueError."""
        parts = relative_parts(file_path)
        rows = self.spark.read.text("/".join([self.tree, *parts]), wholetext=True).collect()
        return "".join(r["value"] for r in rows)

    def exclude(self, short: str) -> str | None:
        """Exclude the pair of the latest report with this short id; returns its key, null if there is none."""
        row = report.by_short_id(self.findings(), short).select("exclusion").first()
        key = row and row["exclusion"]
        if key:
            c = self.config()
            cfg.save(self.tree, replace(c, excludedPairs=exclusions.add_exclusion(list(c.excludedPairs), key)))
        return key

    def clean(self) -> tuple[list[str], list[str]]:
        """Update, then drop exclusions that no pair of units matches: (kept, removed)."""
        self.update()
        c = self.config()
        named = self.store.read("units").select("unit_type", label_of(F.col("unit_type"), F.col("name"), F.col("file_path"), F.col("code")).alias("label"))
        kept, removed = exclusions.clean_exclusions(list(c.excludedPairs), named)
        cfg.save(self.tree, replace(c, excludedPairs=kept))
        return kept, removed
