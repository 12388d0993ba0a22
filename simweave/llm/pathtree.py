"""URL filters: rules, and a tree of path templates learned from labelled URLs.

Segments that are plainly variable (numbers, hexadecimal names, long names with
digits) become wildcards by their form. Then each host's tree is walked level by
level over the aggregated paths: where a node has many children, those that are
seen about once are values of a variable segment and become ``*``; of the other
children, those whose share of good labels does not differ significantly from
their siblings' merge into ``*``, and those that differ stay apart. A template
is rejected if its smoothed purity - good labels over all, shrunk towards the
host's and that towards the overall share - is below a threshold.

Everything is counted over (host, path form) first, so a host with a third of
all URLs is many small groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simweave.scratch import discard, materialize, scratch_path


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    many: int = 20
    repeats: float = 3.0
    z: float = 1.96
    prior: float = 10.0
    threshold: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end. Both empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits the host or a parent domain of it and begins the path, as struct (name, verdict), else null."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<name: string, verdict: string>")


def segments(path: Column) -> Column:
    """The path's segments with variable forms generalised."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")

    def form(s: Column) -> Column:
        number = F.regexp_replace(s, r"[0-9]+", "<n>")
        return F.when(s.rlike(r"^[0-9a-fA-F-]{12,}$"), F.lit("<x>")).when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.concat(F.lit("<n>"), F.regexp_extract(s, r"(\.[A-Za-z0-9]+)?$", 0))).when((F.length(s) > 24) & s.rlike("[0-9]"), F.lit("<x>")).otherwise(number)

    return F.transform(parts, form)


def templates(urls: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``urls`` (host, segs, labelled, good: the counts of labels that a URL has) -> (host, segs, template, purity), a row for each path form of a host."""
    now = materialize(urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).withColumn("template", F.array().cast("array<string>")), "paths")
    # path forms that end, or that are alone below their node, leave the walk
    ready, level = scratch_path(urls.sparkSession, "ready"), 0
    now.limit(0).write.parquet(ready)
    columns = now.columns
    while not now.isEmpty():
        at = now.withColumn("child", F.get("segs", F.lit(level)))
        children = at.where("child is not null").groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("good").alias("g"), F.count("*").alias("forms"))
        node = children.groupBy("host", "template").agg(F.sum("n").alias("nn"), F.count("*").alias("kinds"), F.count_if(F.col("n") < settings.repeats).alias("rare"), F.sum("l").alias("nl"), F.sum("g").alias("ng"))
        # many children that come about once are a variable segment's values; a sibling that comes often is judged like any other
        variable = (F.col("rare") >= settings.many) & (F.col("n") < settings.repeats)
        rest_l, rest_g = F.col("nl") - F.col("l"), F.col("ng") - F.col("g")
        pooled = F.try_divide("ng", "nl")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), rest_l)))
        gap = F.abs(F.try_divide("g", "l") - F.try_divide(rest_g, rest_l))
        # no label on one side, or all labels alike: nothing tells them apart
        similar = F.coalesce((error == 0) | (gap < settings.z * error), F.lit(True))
        chosen = children.join(node, ["host", "template"]).select("host", "template", "child", F.when(variable | ((F.col("kinds") > 1) & similar), F.lit("*")).otherwise(F.col("child")).alias("to"), "forms")
        alone = (F.col("forms") == 1) & (F.col("to") == F.col("child")) & (F.col("child") != "*")
        rest = F.when(alone, F.slice("segs", level + 2, F.greatest(F.size("segs"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
        open_ = ~alone & (F.size("segs") > level + 1)
        new = materialize(at.join(chosen, ["host", "template", "child"]).select(*[c for c in columns if c != "template"], F.concat("template", F.array("to"), rest).alias("template"), open_.alias("open")), "paths")
        new.where("not open").select(columns).write.mode("append").parquet(ready)
        discard(now)
        left = materialize(new.where("open").select(columns), "paths")
        discard(new)
        now, level = left, level + 1
    now = urls.sparkSession.read.schema(now.schema).parquet(ready)
    share = lambda good, labelled, prior: (F.col(good) + settings.prior * prior) / (F.col(labelled) + settings.prior)
    overall = now.agg((F.try_divide(F.sum("good"), F.sum("labelled"))).alias("p")).first()["p"]
    hosts = now.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hl")).withColumn("host_share", share("hg", "hl", F.lit(1.0 if overall is None else float(overall)))).select("host", "host_share")
    groups = now.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("labelled").alias("tl")).join(hosts, "host").withColumn("purity", share("tg", "tl", F.col("host_share"))).select("host", "template", "purity")
    return now.select("host", "segs", "template").join(groups, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``pages`` (page_id, url), ``labels`` (page_id, good 0/1) -> (page_id, host, path, rule, verdict, template, purity), a row for each page.

    A rule's verdict goes before the tree's. Null labels are left out, a page
    labelled twice counts twice; rows without page_id are judged but have no
    label. Without labels nothing is rejected. Null urls and urls without
    ``://`` have an empty host and path, and form one template.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = segments(F.col("path"))
    told = labels.where("good is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum("good").alias("good"))
    urls = parsed.join(told, "page_id", "left").select("host", split.alias("segs"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("good", F.lit(0)).alias("good"))
    tree = materialize(templates(urls, settings), "templates")
    rule = matched(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("segs", split).join(tree, ["host", "segs"])
    return judged.withColumn("r", rule).select("page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", F.when(F.col("purity") < settings.threshold, "block").otherwise("allow")).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
