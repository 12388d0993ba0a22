"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every step is a DataFrame or SQL expression.

Documents fall into blocks of about ``BLOCK_DOCS`` by hash, within their
source. A source's target in words is some whole passes over it plus a rest;
each pass draws whole blocks in permuted order, and one block a source is cut
so that the words come out exactly. The block draws of all sources are dealt to
the output shards by a binary tree: each node splits its counts of draws by
source into halves with the multivariate hypergeometric distribution, so every
shard gets an exact quota of every source, and quotas add up to the draws. The
draws of a source, permuted, are handed out along these quotas: shards are
disjoint. Inside a shard, rows are ordered by hash. What a document gives to
the mix is counted from the draws that its block got from the tree.

No task holds a source: running sums go by ranges of the permuted order, first
over the ranges' sums and then inside each range, and documents are sorted only
inside the cut blocks, by their distinct keys.

Hashes are the leading 60 bits of MD5, which other engines have too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simweave.llm.lines import numbered, running
from simweave.scratch import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 256
#: Rows of a shard that the number of shards aims at.
SHARD_ROWS = 16384
#: Ranges of the permuted order, by the hash's upper bits.
RANGES = 12
#: Places of a range of draws.
PLACES = 1 << 14


def _hash(seed: int, *columns: str) -> Column:
    """60 bits of the MD5 of the seed and the columns as text, null as ``-``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def _key(seed: int) -> Column:
    return _hash(seed, "doc_id", "text")


def targets(totals: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, source_size, docs) -> also ``rank``, ``weight`` and ``target``.

    Weights repeat along the sources by code point, null last. Targets share
    all words by weight; one stops at max_repeats times its source's size and
    its excess goes to the others by weight.
    """
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy("ratio", "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = capped.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return level.withColumn("target", F.when(open_level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), open_level * F.col("weight")))).drop("cap", "ratio", "level")


def _ln_factorial(x: str) -> str:
    """ln x!, by Stirling's series eight steps further up; its error is below 1e-12."""
    z = f"({x} + 9D)"
    steps = " * ".join(f"({x} + {k}D)" for k in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) - ln({steps}))"


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def _hypergeometric(pop: str, good: str, draws: str, u: str) -> str:
    """SQL for the number of good ones among draws from pop, by inversion at ``u`` within 12 standard deviations (all of the mass in double precision)."""
    mean = f"({draws} * {good} / greatest({pop}, 1))"
    width = f"cast(12 * sqrt({mean}) + 12 as bigint)"
    lo = f"greatest(0L, {draws} + {good} - {pop}, cast({mean} as bigint) - {width})"
    hi = f"least({draws}, {good}, cast({mean} as bigint) + {width})"
    p = f"exp({_ln_choose(good, 'x')} + {_ln_choose(f'({pop} - {good})', f'({draws} - x)')} - {_ln_choose(pop, draws)})"
    return f"aggregate(sequence({lo}, {hi}), named_struct('c', 0D, 'x', -1L), (acc, x) -> if(acc.c >= {u}, acc, named_struct('c', acc.c + {p}, 'x', x)), acc -> acc.x)"


def split_tree(counts: DataFrame, depth: int, seed: int) -> DataFrame:
    """One row with ``n``, an array of counts -> 2**depth rows (shard, n) with exact shares, and the other columns.

    A node's draws are halved (the left child gets the smaller half); the left
    child's counts follow the multivariate hypergeometric distribution.
    """
    others = [c for c in counts.columns if c != "n"]
    node = counts.select(F.lit(1).cast("long").alias("node"), "n", *others)
    total = "aggregate(n, 0L, (s, k) -> s + k)"
    u = f"(pmod(xxhash64({seed}, node, size(a.out)), 4503599627370496L) + 0.5D) / 4503599627370496D"
    step = f"transform(array({_hypergeometric('a.pop', 'k', 'a.draws', u)}), y -> named_struct('pop', a.pop - k, 'draws', a.draws - y, 'out', concat(a.out, array(y))))[0]"
    left = f"aggregate(n, named_struct('pop', {total}, 'draws', {total} div 2, 'out', cast(array() as array<bigint>)), (a, k) -> {step}, a -> a.out)"
    for level in range(depth):
        if level == 6:
            node = node.repartition("node")  # deeper trees are many nodes
        node = node.selectExpr(*others, f"inline(transform(array(0L, 1L), side -> named_struct('node', 2 * node + side, 'n', transform(array({left}), l -> if(side = 0, l, zip_with(n, l, (x, y) -> x - y)))[0])))")
    return node.select((F.col("node") - F.lit(1 << depth)).cast("int").alias("shard"), "n", *others)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, depth: int | None = None, seed: int = 4) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``docs`` (doc_id, text, source) -> (rows, sources, blocks, depth).

    ``rows``: a number of the row, doc_id, source, size in words, hash key.
    ``sources``: totals, targets, rank and the number of blocks. ``blocks``: for
    each block that is drawn the output shard of every draw, whether the last
    draw takes it (part: all or cut; none if the last pass does not draw it), up
    to which key and how many words at that key. ``depth``: of the tree; by
    default it grows with the rows, so that shards do not.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _key(seed).alias("key")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = materialize(targets(totals, weights, max_repeats).withColumn("n_blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long")).withColumn("quota", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")), "sources")
    if depth is None:
        n = sources.coalesce(1).agg(F.sum("docs")).first()[0] or 0
        depth = max(0, math.ceil(math.log2(max(n, 1) / SHARD_ROWS)))
    placed = in_blocks(rows, sources)
    by_block = materialize(placed.groupBy("rank", "block").agg(F.sum("size").alias("words")).withColumn("h", _hash(seed + 1, "block")), "words")
    before = running(by_block, ["rank"], F.shiftright("h", 60 - RANGES), ["h", "block"], "words", "before")
    drawn = before.join(sources.select("rank", "passes", "rest"), "rank").withColumn("part", F.expr("case when before >= rest then 'none' when before + words <= rest then 'all' else 'cut' end"))
    drawn = materialize(drawn, "blocks")

    cut = drawn.where("part = 'cut'").select("rank", "block", (F.col("rest") - F.col("before")).alias("open"))
    inside = placed.join(cut, ["rank", "block"]).groupBy("rank", "block", "open", "key").agg(F.sum("size").alias("size"))
    running_ = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("rank", "block").orderBy("key")))
    cuts = running_.where("upto >= open").groupBy("rank", "block").agg(F.min(F.struct("key", (F.col("open") - F.col("upto") + F.col("size")).alias("w"))).alias("m")).select("rank", "block", F.col("m.key").alias("cut_key"), F.col("m.w").alias("cut_words"))

    units = drawn.withColumn("draws", F.col("passes") + F.when(F.col("part") == "none", 0).otherwise(1)).where("draws > 0").select("rank", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("pass"))
    units = materialize(units.withColumn("h", _hash(seed + 2, "block", "pass")).withColumn("one", F.lit(1)), "units")
    at = running(units, ["rank"], F.shiftright("h", 60 - RANGES), ["h", "block", "pass"], "one", "place")
    counts = units.groupBy("rank").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("s"))
    leaves = split_tree(counts.select(F.col("s.n").alias("n"), F.col("s.rank").alias("ranks")), depth, seed + 3)
    # a draw's shard is the number of shards that end at or before its place
    by_shard = Window.partitionBy("rank").orderBy("shard")
    ends = leaves.select("shard", F.inline(F.arrays_zip("ranks", "n")).alias("rank", "n")).select("rank", F.sum("n").over(by_shard).alias("place"), F.lit(1).alias("end"))
    along = materialize(at.select("rank", "place", F.lit(0).alias("end"), "block", "pass").unionByName(ends, allowMissingColumns=True), "along")
    counted = running(along, ["rank"], F.floor(F.col("place") / PLACES), ["place", F.desc("end"), "block", "pass"], "end", "shard").where("end = 0")
    shards = counted.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", F.col("shard").cast("int").alias("shard")))).alias("d")).select("rank", "block", F.col("d.shard").alias("shards"))
    blocks = materialize(shards.join(drawn.select("rank", "block", "part"), ["rank", "block"]).join(cuts, ["rank", "block"], "left"), "draws")
    discard(by_block, drawn, units, along)
    return rows, sources, blocks, depth


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's rank, size and target and the block of each row; ``sources`` is one row a source."""
    # <=> for the null source
    return rows.alias("r").join(sources.select("source", "rank", "n_blocks", "source_size", "target").alias("s"), F.expr("r.source <=> s.source")).select("r.*", "rank", "source_size", "target", F.pmod(F.col("key"), F.col("n_blocks")).alias("block"))


def _with_draws(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds the block's ``shards``, the number of whole ``passes`` among them, and ``last``: how many words the last one takes.

    Rows that agree in the key on which a cut falls are numbered, and taken
    whole until one is cut.
    """
    joined = rows.join(blocks, ["rank", "block"], "left").withColumn("passes", F.coalesce(F.size("shards"), F.lit(0)) - F.when(F.col("part").isin("all", "cut"), 1).otherwise(0))
    on_cut = F.coalesce((F.col("part") == "cut") & (F.col("key") == F.col("cut_key")), F.lit(False))
    last = F.expr("case when part = 'all' or key < cut_key then size else 0 end")
    alike = numbered(materialize(joined.where(on_cut), "cut"), ["rank", "block", "key"])
    share = F.least(F.col("size"), F.greatest(F.lit(0), F.col("cut_words") - F.col("nth") * F.col("size")))
    return joined.where(~on_cut).withColumn("last", last).unionByName(alike.withColumn("last", share).drop("nth"))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 4) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for each row of ``docs``.

    A null or blank text has size 0 and nothing is taken of it. Null sources
    are one source, the last. Rows that repeat in all of doc_id and text are
    rows of their own: where the cut falls on them, some are taken whole, one
    is cut, and the others get nothing more. An empty table gives an empty one;
    other columns are ignored.
    """
    rows, sources, blocks, _ = plan(docs, weights, max_repeats, seed=seed)
    return _with_draws(in_blocks(rows, sources), blocks).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("last")).cast("long").alias("taken"), "shards")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, depth: int | None = None, seed: int = 4) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is drawn, dealt to 2**depth shards and shuffled in each.

    The one document of a source on which its cut falls is put out whole; rows
    of size 0 come with the passes of their block. Nulls, repeats and an empty
    table are as for :func:`taken_words`; the columns of ``docs`` may have any names.
    """
    _, sources, blocks, depth = plan(docs, weights, max_repeats, depth, seed)
    keyed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _key(seed).alias("key"))
    drawn = _with_draws(in_blocks(keyed, sources), blocks)
    with_last = (F.col("last") > 0) | ((F.col("size") == 0) & F.coalesce((F.col("part") == "all") | (F.col("key") <= F.col("cut_key")), F.lit(False)))
    times = F.col("passes") + F.when(with_last, 1).otherwise(0)
    draws = drawn.withColumn("times", times.cast("int")).where("times > 0").select("doc", "key", F.posexplode(F.slice("shards", F.lit(1), F.col("times"))).alias("pass", "shard"))
    dealt = draws.repartitionById(1 << depth, F.col("shard")).sortWithinPartitions("shard", _hash(seed + 4, "key", "pass"))
    return dealt.select("doc.*")
