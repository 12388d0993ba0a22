"""The library's operators as queries over the supplied tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.functions import labels as lb
from simweave.functions import text as tx
from simweave.operators import exclusions, incremental, pairs, score, similarity, units, verdicts
from simweave.plans import report
from simweave.plans import tables as t
from simweave.scratch import materialize
from simweave.streaming.edits import debounced, real_edits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Excluded pairs of the exclusion queries: two exact, one by globs, two malformed.
EXCLUSIONS = ["function|d100(arity:0)|d101(arity:0)", "function|d1(arity:0)|d2(arity:0)", "class|src*|src1?", "FUNCTION|a|b", "block|only-two"]
NORMAL = "regexp_replace(regexp_replace(regexp_replace({0}, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\r\\n]*', '', 'g'), '\\s+', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- text, ids, labels

@query(f"SELECT {t.PATH} AS file_path, md5(text) AS checksum FROM documents")
def file_checksum_md5(spark, d):
    return t.table(spark, d, "documents").select(t.doc_path().alias("file_path"), F.md5("text").alias("checksum"))


@query(f"SELECT doc_id, sha1({NORMAL.format('text')}) AS block_hash FROM documents")
def norm_block_sha1(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.sha1(tx.normalize_code(F.col("text"))).alias("block_hash"))


@query(f"WITH h AS (SELECT doc_id, sha1({NORMAL.format('text')}) AS block_hash FROM documents), c AS (SELECT block_hash, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY block_hash HAVING count(*) > 1) SELECT doc_id, first_doc, copies, block_hash FROM h JOIN c USING (block_hash)")
def block_exact_pairs(spark, d):
    """Blocks that are equal but for white space and comments: each member of a class paired with its first one, not with all others."""
    return units.exact_copies(materialize(norm_block_sha1(spark, d), "hashes"), "block_hash", "doc_id").select("doc_id", F.col("first").alias("first_doc"), "copies", "block_hash")


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?s)^[^{]*?\\([^)]*\\)') THEN len(list_filter(string_split(regexp_extract(html, '(?s)^[^{]*?\\(([^)]*)\\)', 1), ','), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '')) ELSE 0 END AS arity FROM pages")
def arity_extract(spark, d):
    return t.table(spark, d, "pages").select("page_id", tx.arity(F.col("html")).cast("long").alias("arity"))


@query(f"WITH {t.FUNCTIONS} SELECT doc_id, id FROM functions")
def unit_id_build(spark, d):
    return t.functions(spark, d).select("doc_id", "id")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN concat(p_name, '(arity:', array_length(string_split(p_type, ' ')), ')') ELSE sha1(regexp_replace(p_type, '\\s+', '', 'g')) END AS label FROM part")
def unit_labels(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("block")
    code = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("f("), F.replace("p_type", F.lit(" "), F.lit(",")), F.lit(") { }"))).otherwise(F.col("p_type"))
    return t.table(spark, d, "part").select("p_partkey", lb.unit_label(kind, F.col("p_name"), F.col("p_name"), code).alias("label"))


@query("SELECT p_partkey, concat('block|', least(p_name, p_type), '|', greatest(p_name, p_type)) AS pair_key, concat(least(p_name, p_type), '::', greatest(p_name, p_type)) AS id_key, substr(sha1(concat('block|', least(p_name, p_type), '|', greatest(p_name, p_type))), 1, 12) AS short_id FROM part")
def pair_key_build(spark, d):
    key = lb.pair_key(F.lit("block"), F.col("p_name"), F.col("p_type"))
    return t.table(spark, d, "part").select("p_partkey", key.alias("pair_key"), lb.id_key(F.col("p_name"), F.col("p_type")).alias("id_key"), lb.short_id(key).alias("short_id"))


_RAW = "CASE WHEN p_size % 4 = 0 THEN concat('class|', p_type, '|', p_name) WHEN p_size % 4 = 1 THEN concat('block|', p_name, '|', p_type) WHEN p_size % 4 = 2 THEN concat('Block|', p_name, '|', p_type) ELSE concat('function|', p_name) END"


@query(f"WITH r AS (SELECT p_partkey, p_name, p_type, p_size, {_RAW} AS raw FROM part) SELECT p_partkey, raw, CASE WHEN p_size % 4 = 0 THEN 'class' WHEN p_size % 4 = 1 THEN 'block' END AS unit_type, CASE WHEN p_size % 4 < 2 THEN least(p_name, p_type) END AS left_label, CASE WHEN p_size % 4 < 2 THEN greatest(p_name, p_type) END AS right_label FROM r")
def pair_key_parse(spark, d):
    raw = t.table(spark, d, "part").select("p_partkey", F.expr(_RAW).alias("raw")).withColumn("p", lb.parse_pair_key(F.col("raw")))
    return raw.select("p_partkey", "raw", F.col("p.type").alias("unit_type"), F.col("p.left").alias("left_label"), F.col("p.right").alias("right_label"))


# ---- filters, projections

_ACCESSOR = "concat(CASE p_size % 4 WHEN 0 THEN 'A.get' WHEN 1 THEN 'A.set' WHEN 2 THEN 'A.is' ELSE 'A.geT' END, p_brand)"


@query(f"WITH n AS (SELECT p_partkey, {_ACCESSOR} AS name, p_partkey % 3 AS arity FROM part) SELECT p_partkey, name FROM n WHERE NOT ((regexp_matches(split_part(name, '.', -1), '^(get|is)[A-Z]') AND arity = 0) OR (regexp_matches(split_part(name, '.', -1), '^set[A-Z]') AND arity <= 1))")
def trivial_accessor_filter(spark, d):
    named = t.table(spark, d, "part").select("p_partkey", F.expr(_ACCESSOR).alias("name"), (F.col("p_partkey") % 3).alias("arity"))
    return named.where(~tx.trivial_accessor(F.col("name"), F.col("arity"))).select("p_partkey", "name")


@query(f"WITH {t.UNITS} SELECT id, unit_type FROM units WHERE end_line - start_line >= CASE WHEN unit_type = 'block' THEN 5 ELSE 3 END")
def min_lines_filter(spark, d):
    return t.units(spark, d).where(units.long_enough(F.col("unit_type"), F.col("start_line"), F.col("end_line"), 3, 0)).select("id", "unit_type")


@query("SELECT page_id, url FROM pages WHERE ends_with(lower(url), '.html') OR ends_with(lower(url), '/')")
def supported_ext_filter(spark, d):
    return t.table(spark, d, "pages").where(tx.supported(F.col("url"), (".html", "/"))).select("page_id", "url")


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, path FROM p WHERE NOT (regexp_matches(path, '^([^/]*/)*en/.*$') OR regexp_matches(path, '^m\\.[^/]*/[^/]*/[^/]*$'))")
def path_glob_filter(spark, d):
    p = t.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.where(~tx.matches_glob(F.col("path"), ["**/en/**", "m.*/*/*"]))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, path, CASE WHEN regexp_matches(path, '(^|/)fr/') THEN false WHEN regexp_matches(path, '\\.html(/.*)?$') THEN true WHEN regexp_matches(path, '^tion[^/]*/.*') THEN true ELSE false END AS ignored FROM p")
def ignore_rules_last_match(spark, d):
    from simweave.sources.files import ignored

    p = t.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.withColumn("ignored", ignored(F.col("path"), ["/tion*/**", "*.html", "!fr/"]))


@query("SELECT doc_id, n AS chunk, substr(text, n * 2048 + 1, 2048) AS code FROM documents, unnest(range(0, CAST(greatest(ceil(length(text) / 2048.0), 1) AS BIGINT))) AS u(n)")
def chunk_split(spark, d):
    rows = t.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("text").alias("code"))
    out = units.split_long(rows, 2048)
    return out.select("doc_id", F.coalesce(F.regexp_extract("id", ":chunk([0-9]+)$", 1), F.lit("")).alias("c"), "code").select("doc_id", F.when(F.col("c") == "", "0").otherwise(F.col("c")).cast("long").alias("chunk"), "code")


@query("SELECT doc_id, length(text) > 2048 OR embedding IS NULL AS without_vector FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def context_length_null(spark, d):
    f = t.functions(spark, d)
    return f.select("doc_id", (~units.embedded(units.within_context(F.col("code"), F.col("embedding"), 2048))).alias("without_vector"))


# ---- units

@query(f"WITH {t.UNITS} SELECT count(*) FILTER (unit_type = 'class') AS classes, count(*) FILTER (unit_type = 'function') AS functions, count(*) FILTER (unit_type = 'block') AS blocks, count(*) AS total FROM units")
def unit_type_counts(spark, d):
    return units.type_counts(t.units(spark, d))


@query(f"WITH {t.UNITS} SELECT CAST(sum(end_line - start_line + 1) AS BIGINT) AS total_lines FROM units")
def total_lines(spark, d):
    return t.units(spark, d).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines"))


@query(f"WITH {t.UNITS} SELECT u.id, p.id AS parent, CASE WHEN p.unit_type = 'function' THEN p.id END AS function_id, CASE WHEN p.unit_type = 'class' THEN p.id ELSE g.id END AS class_id FROM units u LEFT JOIN units p ON u.parent_id = p.id LEFT JOIN units g ON p.parent_id = g.id")
def parent_child_join(spark, d):
    u = units.with_parents(t.units(spark, d), depth=2)
    return u.select("id", F.col("parent_id").alias("parent"), "function_id", "class_id")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def last_wins_dedupe(spark, d):
    docs = t.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("id"), "source", "lang", "doc_id", F.col("doc_id").alias("seq"))
    return units.latest_by_id(docs, "seq").select("source", "lang", "doc_id")


@query(f"WITH {t.FUNCTIONS} SELECT id, row_number() OVER (ORDER BY substr(md5(id), 1, 2), id) - 1 AS row FROM functions")
def unit_row_index(spark, d):
    return units.with_row_index(t.functions(spark, d)).select("id", F.col("row").cast("long").alias("row"))


# ---- similarity and pairs

_VECTORS = "v AS (SELECT concat(vec_id, '') AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("unit_type"), "embedding")


@query(f"WITH {_VECTORS} SELECT a.id AS left_id, b.id AS right_id, concat(a.label, '') AS unit_type, round({t.COSINE.format('a.e', 'b.e')}, 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE {t.COSINE.format('a.e', 'b.e')} >= 0.3")
def cosine_pairs_by_type(spark, d):
    return _rounded(similarity.similar_pairs(_vectors(spark, d), 0.3), "similarity")


@query(f"WITH {_VECTORS} SELECT a.id AS left_id, b.id AS right_id, 'all' AS unit_type, round({t.COSINE.format('a.e', 'b.e')}, 6) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE {t.COSINE.format('a.e', 'b.e')} >= 0.3")
def cosine_pairs_all(spark, d):
    return _rounded(similarity.similar_pairs(_vectors(spark, d).withColumn("unit_type", F.lit("all")), 0.3), "similarity")


@query(ORACLES["cosine_pairs_by_type"])
def cosine_pairs_native(spark, d):
    return _rounded(similarity.similar_pairs_by_expression(_vectors(spark, d), 0.3), "similarity")


_WEIGHTED = f"""WITH {t.UNITS}, base AS (
  SELECT l.id AS left_id, r.id AS right_id, l.unit_type, {t.COSINE.format('l.embedding', 'r.embedding')} AS self, l.parent_id AS lp, r.parent_id AS rp
  FROM units l JOIN units r ON l.unit_type = r.unit_type AND l.id < r.id AND len(l.embedding) > 0 AND len(r.embedding) > 0
  WHERE l.unit_type = '{{kind}}' AND NOT (l.unit_type = 'block' AND l.file_path = r.file_path AND ((l.start_line <= r.start_line AND l.end_line >= r.end_line) OR (r.start_line <= l.start_line AND r.end_line >= l.end_line)))),
par AS (SELECT b.*, CASE WHEN lp IS NULL OR rp IS NULL THEN NULL WHEN p.embedding IS NULL OR q.embedding IS NULL THEN 0 ELSE {t.COSINE.format('p.embedding', 'q.embedding')} END AS up
  FROM base b LEFT JOIN units p ON p.id = b.lp LEFT JOIN units q ON q.id = b.rp),
w AS (SELECT left_id, right_id, unit_type, self, CASE WHEN up IS NULL THEN self ELSE ({{own}} * self + 0.2 * up) / ({{own}} + 0.2) END AS sim FROM par)
SELECT left_id, right_id, unit_type, round(self, 6) AS self_similarity, round(sim, 6) AS similarity FROM w WHERE sim >= {{thr}}"""


@query(_WEIGHTED.format(kind="function", own=0.8, thr=0.3))
def weighted_function_similarity(spark, d):
    u = materialize(t.units(spark, d).where(F.col("unit_type").isin("function", "class")).drop("code"), "units")
    return _rounded(pairs.weighted_pairs(u, 0.3, types=("function",)), "self_similarity", "similarity")


@query(_WEIGHTED.format(kind="block", own=0.7, thr=0.8))
def weighted_block_similarity(spark, d):
    u = materialize(t.units(spark, d).where(F.col("unit_type").isin("function", "block")).drop("code"), "units")
    return _rounded(pairs.weighted_pairs(u, 0.8, types=("block",)), "self_similarity", "similarity")


@query(_WEIGHTED.format(kind="class", own=1.0, thr=0.2))
def weighted_class_similarity(spark, d):
    u = materialize(t.units(spark, d).where(F.col("unit_type") == "class").drop("code"), "units")
    return _rounded(pairs.weighted_pairs(u, 0.2, types=("class",)), "self_similarity", "similarity")


@query(f"WITH {t.FUNCTIONS}, {t.BLOCKS} SELECT l.id AS left_id, r.id AS right_id FROM blocks l JOIN blocks r ON l.file_path = r.file_path AND l.id < r.id WHERE NOT ((l.start_line <= r.start_line AND l.end_line >= r.end_line) OR (r.start_line <= l.start_line AND r.end_line >= l.end_line))")
def nested_block_skip(spark, d):
    b = t.blocks(spark, d).select("id", "file_path", "start_line", "end_line")
    l, r = b.alias("l"), b.alias("r")
    both = l.join(r, F.expr("l.file_path = r.file_path and l.id < r.id"))
    nested = pairs.nested_blocks(F.lit("block"), *[F.col(c) for c in ("l.file_path", "l.start_line", "l.end_line", "r.file_path", "r.start_line", "r.end_line")])
    return both.where(~nested).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))


@query(f"WITH {t.FUNCTIONS}, kid AS (SELECT parent_id, embedding AS e FROM functions WHERE embedding IS NOT NULL) SELECT a.parent_id AS lp, b.parent_id AS rp, round(max({t.COSINE.format('a.e', 'b.e')}), 6) AS similarity FROM kid a JOIN kid b ON a.parent_id < b.parent_id GROUP BY ALL")
def child_max_similarity(spark, d):
    f = t.functions(spark, d)
    p = f.where(F.col("embedding").isNotNull()).select(F.col("parent_id").alias("lp")).distinct()
    ends = p.join(p.select(F.col("lp").alias("rp")), F.col("lp") < F.col("rp"))
    return _rounded(pairs.child_similarity(ends, f), "similarity")


# ---- incremental

@query(f"WITH {t.DIFF} SELECT file_path, status FROM diff")
def snapshot_diff(spark, d):
    return incremental.snapshot_diff(t.current_files(spark, d), t.tracked_files(spark, d))


@query(f"WITH {t.DIFF} SELECT file_path FROM diff WHERE status <> 'unchanged'")
def dirty_paths(spark, d):
    return incremental.dirty_paths(snapshot_diff(spark, d))


@query(f"WITH {t.DIFF}, {t.CANDIDATES} SELECT left_id, right_id, similarity FROM pairs WHERE left_file IN (SELECT file_path FROM diff WHERE status <> 'unchanged') OR right_file IN (SELECT file_path FROM diff WHERE status <> 'unchanged')")
def dirty_pair_recompute(spark, d):
    f = t.functions(spark, d)
    dirty = f.join(dirty_paths(spark, d), "file_path", "left_semi").select("id")
    return _rounded(similarity.similar_pairs(f, 0.3, dirty).select("left_id", "right_id", "similarity"), "similarity")


_REUSED = "reused AS (SELECT left_id, right_id, left_file, right_file, similarity FROM pairs WHERE left_file NOT IN (SELECT file_path FROM diff WHERE status <> 'unchanged') AND right_file NOT IN (SELECT file_path FROM diff WHERE status <> 'unchanged'))"


@query(f"WITH {t.DIFF}, {t.CANDIDATES}, {_REUSED} SELECT left_id, right_id, similarity FROM reused")
def report_reuse(spark, d):
    old = t.candidate_pairs(spark, d).select("left_id", "right_id", "left_file", "right_file", "similarity")
    return incremental.reusable_pairs(old, t.functions(spark, d), dirty_paths(spark, d)).select("left_id", "right_id", "similarity")


@query(f"WITH {t.CANDIDATES} SELECT left_id, right_id, CASE WHEN similarity >= 0.32 THEN 2 * similarity ELSE similarity END AS similarity FROM pairs")
def merge_pairs(spark, d):
    old = t.candidate_pairs(spark, d).select("left_id", "right_id", "similarity")
    new = old.where("similarity >= 0.32").select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), (2 * F.col("similarity")).alias("similarity"))
    merged = incremental.merge_pairs(old, new)
    return merged.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(source) ELSE source END AS source FROM documents WHERE source <> 'src7' UNION ALL SELECT doc_id, upper(source) FROM documents WHERE source = 'src7' AND lang = 'fr'")
def upsert_units(spark, d):
    docs = t.table(spark, d, "documents")
    old = docs.where("source <> 'src7'").select("doc_id", "source")
    new = docs.where("lang = 'fr'").select("doc_id", F.upper("source").alias("source"))
    return incremental.upsert(old, new, ["doc_id"])


@query(f"WITH {t.UNITS}, {t.DIFF} SELECT id FROM units WHERE file_path NOT IN (SELECT file_path FROM diff WHERE status <> 'unchanged')")
def delete_units_of_dirty_files(spark, d):
    return incremental.delete_by(t.units(spark, d), dirty_paths(spark, d), "file_path").select("id")


# ---- exclusions and verdicts

@query(f"WITH {t.CANDIDATES} SELECT pair_key, similarity FROM pairs WHERE pair_key NOT IN ('{EXCLUSIONS[0]}', '{EXCLUSIONS[1]}')")
def exclude_exact_antijoin(spark, d):
    return exclusions.exclude_pairs(t.candidate_pairs(spark, d), [k for k in EXCLUSIONS if not k.startswith("class")]).select("pair_key", "similarity")


@query(f"WITH {t.CLASSES} SELECT a.name AS left_label, b.name AS right_label FROM classes a JOIN classes b ON a.name < b.name WHERE NOT ((regexp_matches(a.name, '^src[^/]*$') AND regexp_matches(b.name, '^src1[^/]$')) OR (regexp_matches(b.name, '^src[^/]*$') AND regexp_matches(a.name, '^src1[^/]$')))")
def exclude_glob_antijoin(spark, d):
    c = t.classes(spark, d).select("name")
    both = c.alias("a").join(c.alias("b"), F.expr("a.name < b.name")).select(F.lit("class").alias("unit_type"), F.col("a.name").alias("left_label"), F.col("b.name").alias("right_label"))
    return exclusions.exclude_pairs(both, EXCLUSIONS).select("left_label", "right_label")


@query(f"""WITH {t.UNITS}, lab AS (SELECT unit_type, CASE WHEN unit_type = 'class' THEN file_path ELSE concat(name, '(arity:0)') END AS label FROM units WHERE unit_type <> 'block'),
k AS (SELECT * FROM (VALUES ('{EXCLUSIONS[0]}'), ('{EXCLUSIONS[1]}'), ('{EXCLUSIONS[2]}'), ('{EXCLUSIONS[3]}'), ('{EXCLUSIONS[4]}')) v(key))
SELECT key, CASE WHEN key LIKE 'function|%|%' THEN (SELECT count(*) FROM lab WHERE unit_type = 'function' AND label = split_part(key, '|', 2)) > 0 AND (SELECT count(*) FROM lab WHERE unit_type = 'function' AND label = split_part(key, '|', 3)) > 0
  WHEN key LIKE 'class|%|%' THEN EXISTS (SELECT 1 FROM lab a JOIN lab b ON a.unit_type = 'class' AND b.unit_type = 'class' AND a.label <> b.label WHERE regexp_matches(a.label, '^src[^/]*$') AND regexp_matches(b.label, '^src1[^/]$')) ELSE false END AS kept FROM k""")
def clean_exclusions(spark, d):
    u = t.units(spark, d).where("unit_type <> 'block'")
    named = u.select("unit_type", lb.unit_label(F.col("unit_type"), F.col("name"), F.col("file_path"), F.lit("")).alias("label"))
    kept, removed = exclusions.clean_exclusions(EXCLUSIONS, named)
    return spark.createDataFrame([(k, True) for k in kept] + [(k, False) for k in removed], "key string, kept boolean")


@query(f"WITH {t.UNITS}, {t.CURRENT} SELECT DISTINCT file_path FROM (SELECT file_path FROM units UNION ALL SELECT file_path FROM current_files) WHERE regexp_matches(file_path, '^src1[^/]*/.*$') OR regexp_matches(file_path, '^([^/]*/)*[^/]*7\\.txt$')")
def purge_excluded_paths(spark, d):
    return exclusions.purge_set(t.units(spark, d), t.current_files(spark, d), ["src1*/**", "**/*7.txt"])


@query(f"WITH {t.CANDIDATES}, {t.VERDICTS} SELECT p.pair_key, v.verdict FROM pairs p LEFT JOIN verdicts v ON v.pair_key = p.pair_key")
def verdict_left_join(spark, d):
    found = t.candidate_pairs(spark, d)
    return verdicts.with_cached(found, t.verdicts(spark, d, found)).select("pair_key", "verdict")


@query(f"WITH {t.CANDIDATES}, {t.VERDICTS} SELECT p.pair_key, similarity FROM pairs p LEFT JOIN verdicts v ON v.pair_key = p.pair_key WHERE coalesce(verdict, 'yes') <> 'no'")
def verdict_filter(spark, d):
    found = t.candidate_pairs(spark, d)
    return verdicts.keep_true(verdicts.with_cached(found, t.verdicts(spark, d, found))).select("pair_key", "similarity")


@query(f"WITH {t.DIFF}, {t.CANDIDATES}, {t.VERDICTS} SELECT pair_key, verdict FROM verdicts WHERE left_file NOT IN (SELECT file_path FROM diff WHERE status <> 'unchanged') AND right_file NOT IN (SELECT file_path FROM diff WHERE status <> 'unchanged')")
def verdict_evict(spark, d):
    return incremental.delete_by_either(t.verdicts(spark, d), dirty_paths(spark, d), "left_file", "right_file").select("pair_key", "verdict")


@query(f"WITH {t.DIFF}, {t.CANDIDATES}, {t.VERDICTS} SELECT p.pair_key FROM pairs p LEFT JOIN verdicts v ON v.pair_key = p.pair_key WHERE v.pair_key IS NULL OR p.left_file IN (SELECT file_path FROM diff WHERE status <> 'unchanged') OR p.right_file IN (SELECT file_path FROM diff WHERE status <> 'unchanged')")
def verdict_pending(spark, d):
    found = t.candidate_pairs(spark, d)
    return verdicts.pending(found, t.verdicts(spark, d, found), dirty_paths(spark, d)).select("pair_key")


@query("SELECT conv_id, turn, CASE WHEN starts_with(lower(text), 'yes') THEN 'yes' ELSE 'no' END AS verdict FROM conversations")
def answer_parse(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", verdicts.parse_answer(F.col("text")).alias("verdict"))


# ---- score, reports

def _members(spark, d, rows=None):
    rows = t.candidate_pairs(spark, d) if rows is None else rows
    side = lambda s: F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_file").alias("file_path"), F.col(f"{s}_start").alias("start_line"), F.col(f"{s}_end").alias("end_line")).alias(s)
    return rows.select(F.col("pair_key").alias("id"), "similarity", "unit_type", side("left"), side("right"))


_SCORE = "dup AS (SELECT coalesce(sum(similarity * (left_end - left_start + 1 + right_end - right_start + 1) / 2), 0) AS d, count(*) AS n FROM pairs), tot AS (SELECT sum(end_line - start_line + 1) AS t FROM functions), sc AS (SELECT d, n, t, CASE WHEN n = 0 OR t = 0 THEN 0 ELSE d / t * 100 END AS s FROM dup, tot)"


@query(f"WITH {t.CANDIDATES}, {_SCORE} SELECT round(s, 6) AS score, CASE WHEN s < 5 THEN 'Excellent' WHEN s < 15 THEN 'Good' WHEN s < 30 THEN 'Fair' WHEN s < 50 THEN 'Poor' ELSE 'Critical' END AS grade, CAST(t AS BIGINT) AS total_lines, CAST(round(d) AS BIGINT) AS duplicate_lines, n AS duplicate_groups FROM sc")
def duplication_score(spark, d):
    return _rounded(score.duplication_score(_members(spark, d), t.functions(spark, d)), "score")


@query("SELECT doc_id, CASE WHEN n_chars % 60 < 5 THEN 'Excellent' WHEN n_chars % 60 < 15 THEN 'Good' WHEN n_chars % 60 < 30 THEN 'Fair' WHEN n_chars % 60 < 50 THEN 'Poor' ELSE 'Critical' END AS grade FROM documents")
def grade_case(spark, d):
    return t.table(spark, d, "documents").select("doc_id", tx.grade(F.col("n_chars") % 60).alias("grade"))


@query(f"WITH {t.CANDIDATES}, {t.VERDICTS} SELECT (SELECT count(*) FROM documents WHERE source <> 'src5') AS files_scanned, (SELECT CAST(sum(end_line - start_line + 1) AS BIGINT) FROM functions) AS total_lines, CAST(0 AS BIGINT) AS classes, (SELECT count(*) FROM functions) AS functions, CAST(0 AS BIGINT) AS blocks, (SELECT count(*) FROM functions) AS total, (SELECT count(*) FROM pairs) AS pairs_before, (SELECT count(*) FROM pairs p LEFT JOIN verdicts v ON v.pair_key = p.pair_key WHERE coalesce(verdict, 'yes') <> 'no') AS pairs_after")
def scan_metrics(spark, d):
    before = t.candidate_pairs(spark, d)
    return score.scan_metrics(t.functions(spark, d), t.current_files(spark, d), before, verdicts.keep_true(verdicts.with_cached(before, t.verdicts(spark, d, before))))


@query(f"WITH {t.CANDIDATES}, side AS (SELECT left_file AS file_path, pair_key, similarity, left_start AS start_line, left_end AS end_line, right_file AS other_path FROM pairs UNION ALL SELECT right_file, pair_key, similarity, right_start, right_end, left_file FROM pairs) SELECT file_path, pair_key AS pair_id, similarity, start_line, end_line, other_path FROM side")
def findings(spark, d):
    return score.findings(_members(spark, d))


@query(f"WITH {t.CANDIDATES}, side AS (SELECT left_file AS file_path, pair_key, similarity, right_file AS other FROM pairs UNION ALL SELECT right_file, pair_key, similarity, left_file FROM pairs), r AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n, row_number() OVER (PARTITION BY file_path ORDER BY similarity DESC, pair_key, other) AS r FROM side) SELECT file_path, any_value(n) AS findings, string_agg(other, ',' ORDER BY r) AS others FROM r WHERE r <= 50 GROUP BY file_path")
def findings_per_file(spark, d):
    f = score.findings_per_file(_members(spark, d), shown=50)
    return f.select("file_path", "findings", F.array_join(F.transform("shown", lambda x: x["other_path"]), ",").alias("others"))


@query("SELECT event_id AS run_id, ts AS generated_at, event_type AS grade FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def report_latest(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("generated_at"), F.col("event_type").alias("grade"))
    return report.latest(e)


@query(f"WITH {t.CANDIDATES} SELECT pair_key AS id, similarity FROM pairs ORDER BY similarity DESC, pair_key LIMIT 50 OFFSET 20")
def report_page(spark, d):
    return report.page(_members(spark, d), 20, 50).select("id", "similarity")


@query(f"WITH {t.CANDIDATES} SELECT pair_key AS id, similarity, row_number() OVER (ORDER BY similarity DESC, pair_key) AS rank FROM pairs ORDER BY similarity DESC, pair_key LIMIT 100")
def topk_pairs(spark, d):
    return report.with_rank(report.top(_members(spark, d))).select("id", "similarity", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, concat(array_to_string(list_slice(string_split(text, chr(10)), 1, 15), chr(10)), CASE WHEN len(string_split(text, chr(10))) > 15 THEN concat(chr(10), '... (', len(string_split(text, chr(10))) - 15, ' more lines)') ELSE '' END) AS snippet FROM documents")
def snippet_head(spark, d):
    return t.table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE value > 0),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS first_edit, count(*) AS edits FROM s GROUP BY user_id, n""")
def edit_sessions(spark, d):
    e = t.table(spark, d, "events").select("user_id", "ts", F.col("user_id").cast("string").alias("file_path"), F.col("value").alias("changes"))
    return debounced(real_edits(e), "user_id", "24 hours").select("user_id", F.col("session.start").alias("first_edit"), "edits")


_BODY = "concat('  public int run', p_partkey, '(int a, int b) {', chr(10), '    if (a > b) {', chr(10), '      a += 1;', chr(10), '      b += 2;', chr(10), '      a *= b;', chr(10), '      b -= a;', chr(10), '      a -= 1;', chr(10), '    }', chr(10), '    return a + ', p_size, ';', chr(10), '  }', chr(10))"


@query(f"""WITH m AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS b, concat('run', p_partkey) AS f, {_BODY} AS body FROM part),
o AS (SELECT *, 11 * (row_number() OVER (PARTITION BY b ORDER BY body) - 1) + 1 AS l FROM m),
c AS (SELECT b, 11 * count(*) AS last, concat('class ', b, ' {{', chr(10), string_agg(concat('  public int ', f, '(int a, int b)  {{ }}', chr(10)), chr(10) ORDER BY l), '}}') AS code FROM o GROUP BY b),
u AS (SELECT concat('class:', b, ':0-', last) AS id, b AS name, b, 0 AS first, last, code, 'class' AS unit_type, NULL AS parent_id FROM c
UNION ALL SELECT concat('function:', b, '.', f, ':', l, '-', l + 9), concat(b, '.', f), b, l, l + 9, trim(body, concat(' ', chr(10))), 'function', concat('class:', b, ':0-', last) FROM o JOIN c USING (b)
UNION ALL SELECT concat('block:', b, '.', f, ':', l, '-', l + 9), concat(b, '.', f), b, l, l + 9, trim(substr(body, instr(body, '{{')), chr(10)), 'block', concat('function:', b, '.', f, ':', l, '-', l + 9) FROM o
UNION ALL SELECT concat('block:', b, '.', f, ':', l + 1, '-', l + 7), concat(b, '.', f), b, l + 1, l + 7, regexp_extract(body, '(?s)if \\(a > b\\) (\\{{.*?\\}})', 1), 'block', concat('function:', b, '.', f, ':', l, '-', l + 9) FROM o)
SELECT id, name, concat(b, '.java') AS file_path, CAST(first AS INT) AS start_line, CAST(last AS INT) AS end_line, code, unit_type, parent_id FROM u""")
def java_extract_units(spark, d):
    """Units of Java classes written from the part table: a method a part, brands as classes."""
    from simweave.sources.files import extract_units

    return extract_units(java_files(spark, d), context=2048).drop("embedding")


def java_files(spark, d):
    body = F.expr(_BODY.replace("chr(10)", "'\\n'"))
    files = t.table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("m"))
    return files.select(F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(".java")).alias("file_path"), F.concat(F.lit("class "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(" {\n"), F.col("m"), F.lit("}\n")).alias("text"))
