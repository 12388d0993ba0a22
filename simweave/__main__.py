"""python -m simweave init|update|dupes|exclude|clean [TREE] ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from simweave.engine import Engine
from simweave.plans import report
from simweave.sources.fs import write_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="simweave")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("init", "update", "dupes", "exclude", "clean"):
        s = sub.add_parser(verb)
        if verb == "exclude":
            s.add_argument("id")
        s.add_argument("tree", nargs="?", default=".")
        s.add_argument("--store")
        s.add_argument("--debug", action="store_true")
        if verb == "dupes":
            s.add_argument("--json", action="store_true")
            s.add_argument("--html")
            s.add_argument("--ui", action="store_true", help="write the page into the store and print where it is")
            s.add_argument("--full", action="store_true")
            s.add_argument("--no-llm", action="store_true")
            s.add_argument("--save", metavar="FOLDER")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("simweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.debug else "ERROR")
    e = Engine(spark, a.tree, a.store)
    if a.verb == "init":
        e.init()
    elif a.verb == "update":
        print("\n".join(sorted(r["file_path"] for r in e.update().collect())))
    elif a.verb == "dupes":
        doc = e.report(full=a.full, judge=not a.no_llm)
        if a.save:
            e.save(a.save)
        page = a.html or (f"{e.store.root}/report.html" if a.ui else None)
        if page:
            write_text(page, report.as_html(doc))
            print(page)
        else:
            print(report.as_json(doc) if a.json else report.as_text(doc))
    elif a.verb == "exclude":
        key = e.exclude(a.id)
        print(key or f"no pair {a.id} in the latest report", file=sys.stdout if key else sys.stderr)
        return 0 if key else 1
    else:
        kept, removed = e.clean()
        print(f"{len(removed)} removed, {len(kept)} kept")
    return 0


if __name__ == "__main__":
    sys.exit(main())
