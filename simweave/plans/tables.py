"""Units, files, verdicts and edits read off the supplied tables, with the same tables in SQL.

A source is a class, a document a function of it, a turn of conversation n a
block of document n. Vectors: a document has that of ``embeddings``, a source
the mean of its documents', a turn counts of its words by the first digit of
their md5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.functions.labels import unit_id
from simweave.scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> F.Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def line_breaks(text: F.Column) -> F.Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name, end = F.concat(F.lit("d"), F.col("doc_id").cast("string")), line_breaks(F.col("text")).cast("int")
    rows = docs.select("doc_id", name.alias("name"), doc_path().alias("file_path"), F.lit(0).alias("start_line"), end.alias("end_line"), F.col("text").alias("code"), F.lit("function").alias("unit_type"), F.concat(F.lit("class:"), F.col("source")).alias("parent_id"))
    rows = rows.withColumn("id", unit_id(F.col("unit_type"), F.col("name"), F.col("file_path"), F.col("start_line"), F.col("end_line")))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.join(vectors, "doc_id", "left")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    sizes = docs.groupBy("source").agg(F.count("*").cast("int").alias("n"))
    mean = docs.select("source", F.col("doc_id").alias("vec_id")).join(vectors, "vec_id").select("source", F.posexplode("embedding").alias("i", "e")).groupBy("source", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    mean = mean.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    rows = sizes.join(mean, "source", "left")
    return rows.select(F.concat(F.lit("class:"), F.col("source")).alias("id"), F.col("source").alias("name"), F.col("source").alias("file_path"), F.lit(0).alias("start_line"), F.col("n").alias("end_line"), F.col("source").alias("code"), F.lit("class").alias("unit_type"), F.lit(None).cast("string").alias("parent_id"), "embedding")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    parents = functions(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.col("id").alias("parent_id"))
    digits = F.transform(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.substring(F.md5(w), 1, 1))
    vector = F.transform(F.array(*[F.lit(c) for c in "0123456789abcdef"]), lambda c: F.size(F.filter("d", lambda x: x == c)).cast("float"))
    rows = turns.withColumn("d", digits).withColumn("embedding", vector).withColumn("conv", F.col("conv_id").cast("string"))
    named = rows.select("conv_id", "turn", F.concat(F.lit("block:"), F.col("conv"), F.lit(":"), F.col("turn").cast("string")).alias("id"), F.col("conv").alias("name"), F.concat(F.lit("conv/"), F.col("conv")).alias("file_path"), F.col("turn").cast("int").alias("start_line"), (F.col("turn") + line_breaks(F.col("text"))).cast("int").alias("end_line"), F.col("text").alias("code"), F.lit("block").alias("unit_type"), "embedding")
    return named.join(parents, "conv_id", "left")


UNIT_COLUMNS = ["id", "name", "file_path", "start_line", "end_line", "code", "unit_type", "parent_id", "embedding"]


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units with vectors of doubles."""
    parts = [f(spark, sf_dir).select(*UNIT_COLUMNS[:-1], F.col("embedding").cast("array<double>").alias("embedding")) for f in (classes, functions, blocks)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; their mtime is their id. Those of a fifth source in twenty are gone."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.col("source") != "src5").select(doc_path().alias("file_path"), F.md5("text").alias("checksum"), F.col("doc_id").cast("double").alias("mtime"))


def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of them: without one source; Spanish ones have an older time, German ones an older time and another checksum, French ones another checksum only."""
    docs = table(spark, sf_dir, "documents")
    other = F.col("lang").isin("de", "fr")
    older = F.col("lang").isin("de", "es")
    return docs.where(F.col("source") != "src7").select(doc_path().alias("file_path"), F.when(other, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("checksum"), (F.col("doc_id") - F.when(older, 1).otherwise(0)).cast("double").alias("mtime"))


def candidate_pairs(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Similar documents as candidate pairs with keys, files and labels."""
    from simweave.functions.labels import pair_key, unit_label
    from simweave.operators.similarity import similar_pairs

    label = unit_label(F.col("unit_type"), F.col("name"), F.col("file_path"), F.lit(""))
    f = functions(spark, sf_dir).select("id", "unit_type", "embedding", F.col("doc_id").alias("doc"), F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), label.alias("label"))
    out = similar_pairs(f, threshold, carry=("doc", "file", "start", "end", "label"))
    out = out.withColumn("pair_key", pair_key(F.col("unit_type"), F.col("left_label"), F.col("right_label"))).withColumn("similarity", F.round("similarity", 6))
    # read by several branches of a query: formed once
    return materialize(out, "pairs")


def verdicts(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """A cached verdict for each candidate whose documents are both labelled: no if either is toxic."""
    pairs = candidate_pairs(spark, sf_dir) if pairs is None else pairs
    lab = lambda s: table(spark, sf_dir, "labels").select(F.col("doc_id").alias(f"{s}_doc"), F.col("toxic").alias(f"{s}_toxic"))
    both = pairs.join(lab("left"), "left_doc").join(lab("right"), "right_doc")
    return both.select("pair_key", F.when((F.col("left_toxic") == 1) | (F.col("right_toxic") == 1), "no").otherwise("yes").alias("verdict"), "left_file", "right_file")


PATH = "concat(source, '/', doc_id, '.txt')"
BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"

FUNCTIONS = f"""functions AS (
  SELECT doc_id, concat('d', doc_id) AS name, {PATH} AS file_path, 0 AS start_line, CAST({BREAKS.format('text')} AS INT) AS end_line, text AS code,
         'function' AS unit_type, concat('class:', source) AS parent_id,
         concat('function:', source, '/', doc_id, '.d', doc_id, ':0-', {BREAKS.format('text')}) AS id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
CLASSES = """classes AS (
  SELECT concat('class:', s.source) AS id, s.source AS name, s.source AS file_path, 0 AS start_line, CAST(s.n AS INT) AS end_line, s.source AS code, 'class' AS unit_type, CAST(NULL AS VARCHAR) AS parent_id, m.embedding
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s
  LEFT JOIN (SELECT source, list(m ORDER BY i) AS embedding FROM (
      SELECT source, i, avg(e) AS m FROM (SELECT source, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS e FROM documents JOIN embeddings ON vec_id = doc_id) GROUP BY source, i) GROUP BY source) m ON m.source = s.source)"""
BLOCKS = f"""blocks AS (
  SELECT c.conv_id, turn, concat('block:', conv_id, ':', turn) AS id, concat(conv_id, '') AS name, concat('conv/', conv_id) AS file_path, CAST(turn AS INT) AS start_line,
         CAST(turn + {BREAKS.format('text')} AS INT) AS end_line, text AS code, 'block' AS unit_type, f.id AS parent_id,
         list_transform(string_split('0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f', ','), lambda h: CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND substr(md5(w), 1, 1) = h)) AS DOUBLE)) AS embedding
  FROM conversations c LEFT JOIN (SELECT doc_id, id FROM functions) f ON f.doc_id = conv_id)"""
_COLUMNS = ", ".join(UNIT_COLUMNS)
UNITS = f"{FUNCTIONS}, {CLASSES}, {BLOCKS}, units AS (SELECT {_COLUMNS} FROM classes UNION ALL SELECT {_COLUMNS} FROM functions UNION ALL SELECT {_COLUMNS} FROM blocks)"
COSINE = "CASE WHEN list_inner_product({0}, {0}) * list_inner_product({1}, {1}) = 0 THEN 0 ELSE list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))) END"
CURRENT = f"current_files AS (SELECT {PATH} AS file_path, md5(text) AS checksum, CAST(doc_id AS DOUBLE) AS mtime FROM documents WHERE source <> 'src5')"
TRACKED = f"tracked AS (SELECT {PATH} AS file_path, CASE WHEN lang IN ('de', 'fr') THEN md5(concat(text, '!')) ELSE md5(text) END AS checksum, CAST(doc_id - CASE WHEN lang IN ('de', 'es') THEN 1 ELSE 0 END AS DOUBLE) AS mtime FROM documents WHERE source <> 'src7')"
DIFF = f"""{CURRENT}, {TRACKED}, diff AS (SELECT coalesce(c.file_path, t.file_path) AS file_path,
  CASE WHEN t.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'deleted' WHEN c.mtime = t.mtime OR c.checksum = t.checksum THEN 'unchanged' ELSE 'changed' END AS status
  FROM current_files c FULL OUTER JOIN tracked t ON c.file_path = t.file_path)"""
CANDIDATES = f"""{FUNCTIONS}, cand AS (SELECT l.id AS left_id, r.id AS right_id, l.doc_id AS left_doc, r.doc_id AS right_doc, l.file_path AS left_file, r.file_path AS right_file,
  l.start_line AS left_start, l.end_line AS left_end, r.start_line AS right_start, r.end_line AS right_end, l.code AS left_code, r.code AS right_code,
  concat(l.name, '(arity:0)') AS left_label, concat(r.name, '(arity:0)') AS right_label, 'function' AS unit_type, {COSINE.format('l.embedding', 'r.embedding')} AS sim
  FROM functions l JOIN functions r ON l.id < r.id AND l.embedding IS NOT NULL AND r.embedding IS NOT NULL),
pairs AS (SELECT * EXCLUDE (sim), round(sim, 6) AS similarity, concat('function|', least(left_label, right_label), '|', greatest(left_label, right_label)) AS pair_key FROM cand WHERE sim >= 0.3)"""
VERDICTS = """verdicts AS (SELECT pair_key, CASE WHEN a.toxic = 1 OR b.toxic = 1 THEN 'no' ELSE 'yes' END AS verdict, left_file, right_file
  FROM pairs JOIN labels a ON a.doc_id = left_doc JOIN labels b ON b.doc_id = right_doc)"""
