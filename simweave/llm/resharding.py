"""Resharding at the least movement, by minimum-cost flow.

Old shards offer their bytes, new shards ask for equal shares; a byte that
stays costs nothing, one that moves costs one. The optimum of this
transportation problem (a graph of old and new shards, small whatever the data)
says how many bytes each old shard keeps and sends where. Along a fixed order
of its groups of equal texts every old shard is then cut accordingly: large
groups first by classes of size, so that the cuts fall between small ones, then
by hash. A group goes where the middle of its bytes falls, hence stays
together; one beyond a ``FINE``-th of a share is cut between its documents
where a cut falls into it. Positions come from running sums over ranges of the
order, then over groups, then over salted parts of a group, so no task ever
sorts a shard or a large group.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simweave.llm.lines import SALTS, running
from simweave.scratch import materialize, scratch_path, small_batches

FINE = 64
#: Bits of the ranges of an old shard's order.
RANGES = 12
#: Bytes of text that a task writes.
TASK_BYTES = 128 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Integer flows of least cost from supplies to demands of the same sum (successive shortest paths)."""
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    s, t = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, cap: int, c: int) -> None:
        graph[u].append([v, cap, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i, x in enumerate(supply):
        arc(s, i, x, 0)
    for j, x in enumerate(demand):
        arc(n + j, t, x, 0)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, min(supply[i], demand[j]), cost[i][j])
    while True:
        dist, back = {s: 0}, {}
        queue, inside = deque([s]), {s}
        while queue:
            u = queue.popleft()
            inside.discard(u)
            for k, (v, cap, c, _) in enumerate(graph[u]):
                if cap and dist[u] + c < dist.get(v, 1 << 62):
                    dist[v], back[v] = dist[u] + c, (u, k)
                    if v not in inside:
                        inside.add(v)
                        queue.append(v)
        if t not in dist:
            break
        push, v = 1 << 62, t
        while v != s:
            u, k = back[v]
            push, v = min(push, graph[u][k][1]), u
        v = t
        while v != s:
            u, k = back[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, r in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = graph[v][r][1]
    return flow


def transfers(old: list[int], capacity: list[int], elsewhere: int | None = None) -> list[list[tuple[int, int]]]:
    """For each old shard the (new shard, bytes) pieces that move the fewest bytes; what stays comes first. Nothing of the old shard ``elsewhere`` can stay."""
    flow = min_cost_flow(old, capacity, [[int(i != j or i == elsewhere) for j in range(len(capacity))] for i in range(len(old))])
    return [sorted(((j, x) for j, x in enumerate(row) if x), key=lambda p: (p[0] != i, p[0])) for i, row in enumerate(flow)]


def _options(cut: int, start: int, size: int, each: int, total: int, new_shards: int) -> tuple[int, int]:
    """The ends next to a cut of what stays together there: a group of ``size`` bytes from ``start`` on, or one of its documents."""
    if size * FINE * new_shards <= total:
        return start, start + size
    lo = start + (cut - start) // each * each
    return lo, lo + each * (lo < cut)


def _round_cuts(pieces: list[list[list[int]]], options: dict[tuple[int, int], tuple[int, int]]) -> None:
    """Move every cut to one of its two options, such that the new shards keep their sizes as nearly as can be: widest first, then in passes until none changes."""
    off: dict[int, int] = {}
    moves = []
    for i, ends in enumerate(pieces):
        for k, (cut, shard) in enumerate(ends[:-1]):
            lo, hi = options.get((i, cut), (cut, cut))
            moves.append((hi - lo, i, k, shard, ends[k + 1][1], (lo - cut, hi - cut)))
    now = {}
    for _ in range(9):
        before = dict(now)
        for _, i, k, left, right, ways in sorted(moves, reverse=True):
            gone = now.get((i, k), 0)
            a, b = off.get(left, 0) - gone, off.get(right, 0) + gone
            now[i, k] = best = min(ways, key=lambda w, a=a, b=b: (a + w) ** 2 + (b - w) ** 2)
            off[left], off[right] = a + best, b - best
        if now == before:
            break
    for (i, k), by in now.items():
        pieces[i][k][0] += by
    for ends in pieces:  # two cuts in one group
        for k in range(1, len(ends)):
            ends[k][0] = max(ends[k][0], ends[k - 1][0])


def reshard(docs: DataFrame, new_shards: int = 24, old_shards: int = 16, old: F.Column | None = None, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard), a row for each of its rows.

    ``old`` gives the present shard of a row, 0 to old_shards - 1; by default
    the text's crc32 mod old_shards. A row with another number or null lies in
    no shard yet (old_shard null) and is placed like the others. Law ``bytes``:
    every new shard gets an equal share of all bytes, to within about a
    ``FINE``-th of a share as long as documents are smaller than that. Null
    texts count 8 bytes. Equal texts of one old shard stay together, but for
    groups beyond a ``FINE``-th of a share, which are cut where a shard is full:
    a shard may not hold more than its share. An empty table gives an empty one.

    With ``path``, the affected shards are written below it as (row, slot,
    old_shard) by shard, ``row`` being the whole row of ``docs``, and what is
    returned of them is read off these files. Rows are placed as they are, not
    looked up by doc_id, so null and repeated doc_ids are kept. Other shards
    keep their old files.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = F.pmod(F.crc32(text), F.lit(old_shards)).cast("int") if old is None else old
    present = F.when(given.between(0, old_shards - 1), given).otherwise(old_shards).cast("int")
    columns = ["doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), present.alias("old"), F.xxhash64(text).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")]
    sizes = materialize(docs.select(*columns), "sizes")
    # a row for each old shard
    bytes_by = {r["old"]: r["bytes"] for r in sizes.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
    bytes_of = [bytes_by.get(i, 0) for i in range(old_shards + 1)]
    total = sum(bytes_of)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    pieces = [[[sum(x for _, x in moves[: k + 1]), j] for k, (j, _) in enumerate(moves)] for moves in transfers(bytes_of, capacity, old_shards)]

    # where each group, and each salted part of it, begins along its old shard
    units = materialize(sizes.groupBy("old", "key", "size", "salt").agg(F.count("*").alias("n")), "units")
    groups = units.groupBy("old", "key", "size").agg(F.sum("n").alias("n")).withColumn("bytes", F.col("n") * F.col("size"))
    # how often a group doubles a FINE-th of a share: the largest come first
    rank = -F.greatest(F.lit(0), F.ceil(F.log2(F.col("bytes") * FINE * new_shards / max(total, 1)))).cast("long")
    groups = materialize(groups.withColumn("rank", rank), "groups")
    coarse = F.struct(F.col("rank"), F.shiftright("key", 64 - RANGES))
    by = running(groups, ["old"], coarse, ["rank", "key", "size"], "bytes", "bytes_ahead").select("old", "key", "size", "bytes", "bytes_ahead")
    by = materialize(by.join(running(groups, ["old"], coarse, ["rank", "key", "size"], "n", "rows_ahead").select("old", "key", "size", "rows_ahead"), ["old", "key", "size"]), "ahead")
    inner = spark.createDataFrame([(i, float(upto)) for i, ends in enumerate(pieces) for upto, _ in ends[:-1]], "old int, cut double")
    # a row for each cut: there are fewer than old and new shards
    hit = by.join(F.broadcast(inner), "old").where("bytes_ahead < cut and cut < bytes_ahead + bytes").select("old", "cut", "bytes_ahead", "bytes", "size").collect()
    _round_cuts(pieces, {(r["old"], int(r["cut"])): _options(int(r["cut"]), r["bytes_ahead"], r["bytes"], r["size"], total, new_shards) for r in hit})
    cuts = spark.createDataFrame([(i, [(float(upto), j) for upto, j in ends] or [(0.0, i % new_shards)]) for i, ends in enumerate(pieces)], "old int, ends array<struct<upto: double, shard: int>>")
    salted = Window.partitionBy("old", "key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    units = materialize(units.withColumn("before", F.coalesce(F.sum("n").over(salted), F.lit(0))).join(by, ["old", "key", "size"]), "places")

    within = Window.partitionBy("old", "key", "size", "salt").orderBy("doc_id")
    nth = F.col("before") + F.col("nth") - 1
    middle = F.col("bytes_ahead") + F.when(F.col("bytes") * FINE * new_shards <= total, F.col("bytes") / 2).otherwise((nth + 0.5) * F.col("size"))

    def lined(rows: DataFrame) -> DataFrame:
        line = rows.join(units, ["old", "key", "size", "salt"]).withColumn("nth", F.row_number().over(within))
        line = line.withColumn("middle", middle).withColumn("row", F.col("rows_ahead") + nth).join(F.broadcast(cuts), "old")
        return line.withColumn("shard", F.expr("coalesce(filter(ends, e -> e.upto >= middle)[0].shard, ends[size(ends) - 1].shard)"))

    line = materialize(lined(sizes).select("doc_id", "size", "text_crc32", "old", "shard", "row"), "line")
    first = line.groupBy("shard", "old").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    first = materialize(first.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("old").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "first")
    # a row for each (new shard, old shard): at most their product
    slotted = lambda rows: rows.join(F.broadcast(first.drop("n")), ["shard", "old"]).withColumn("slot", F.col("ahead") + F.col("row") - F.col("first")).withColumn("old_shard", F.when(F.col("old") < old_shards, F.col("old")))
    shown = lambda rows: rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
    out = shown(slotted(line))
    names = [] if path is None else [r["shard"] for r in affected(out).select("shard").collect()]
    if not names:
        return out
    # rows with equal doc_id and text may swap places between the two orderings
    whole = slotted(lined(docs.select(*columns, F.struct("*").alias("whole"))).where(F.col("shard").isin(names)))
    # every task writes a file for each shard that it holds rows of: fewer and larger tasks write fewer files
    whole = whole.select(F.col("whole").alias("row"), "slot", "old_shard", "shard").coalesce(max(1, -(-total // TASK_BYTES)))
    with small_batches(spark):
        whole.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    files = spark.read.schema(whole.schema).parquet(path)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    read = files.select(F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot", "old_shard")
    return shown(read).unionByName(out.where(~F.col("shard").isin(names)))


def resharded(docs: DataFrame, new_shards: int = 24, old_shards: int = 16, old: F.Column | None = None) -> DataFrame:
    """:func:`reshard`, with the affected shards written to the shared folder."""
    return reshard(docs, new_shards, old_shards, old, scratch_path(docs.sparkSession, "shards"))


def affected(plan: DataFrame) -> DataFrame:
    """The shards whose files change: (shard, rows_in, rows_out), in ascending order of shard."""
    moved = plan.where("not shard <=> old_shard")
    both = moved.select("shard", F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(moved.where("old_shard is not null").select("old_shard", F.lit(0), F.lit(1)))
    return both.groupBy("shard").agg(F.sum("i").alias("rows_in"), F.sum("o").alias("rows_out")).orderBy("shard")
