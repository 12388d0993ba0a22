"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from simweave.llm.pathtree import Rule, TreeSettings

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: A base32 digit of each five bits of a hexadecimal SHA-1.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST(concat('0x', substr(sha, CAST(i * 5 + 1 AS INT), 5)) AS INT) >> b) & 31) + 1, 1)), '')), '')"""

def _md5(seed: int, *columns: str) -> str:
    """60 bits of the MD5 of the seed and the columns."""
    return f"CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)})), 1, 15)) AS BIGINT)"


#: Targets by filling up, then passes and the cut of the permuted blocks; which shard gets which draw changes none of these columns.
OP4_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, {_md5(4, "doc_id", "text")} AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / 256.0) AS BIGINT) AS n_blocks, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
c AS (SELECT *, [1.0, 2.0, 3.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, cap / weight AS ratio FROM t),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
o AS (SELECT (SELECT level FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1) AS open),
s AS (SELECT source, source_size, n_blocks, rank, CASE WHEN open IS NULL THEN cap ELSE least(cap, open * weight) END AS target, CAST(round(CASE WHEN open IS NULL THEN cap ELSE least(cap, open * weight) END) AS BIGINT) AS quota FROM l, o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes, quota - passes * source_size AS rest FROM s),
p AS (SELECT d.doc_id, size, key, source_size, target, rank, passes, rest, key % n_blocks AS block FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT rank, block, any_value(rest) AS rest, sum(size) AS words, {_md5(5, "block")} AS h FROM p GROUP BY rank, block),
r AS (SELECT rank, block, words, rest - coalesce(sum(words) OVER (PARTITION BY rank ORDER BY h, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM b),
i AS (SELECT p.*, open, words, coalesce(sum(size) OVER (PARTITION BY p.rank, p.block ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN r ON r.rank = p.rank AND r.block = p.block)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + CASE WHEN open >= words THEN size ELSE greatest(0, least(size, open - before)) END AS BIGINT) AS taken FROM i"""

OP8_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, ways.b FROM r JOIN ways ON ways.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP9_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT sha, max(page_id) AS last FROM p GROUP BY sha)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m USING (sha)"""


_FORM = """CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{12,}$') THEN '<x>' WHEN regexp_matches(s, '^[0-9]+(\\.[A-Za-z0-9]{1,5})?$') THEN concat('<n>', regexp_extract(s, '(\\.[A-Za-z0-9]+)?$', 0))
  WHEN length(s) > 24 AND regexp_matches(s, '[0-9]') THEN '<x>' ELSE regexp_replace(s, '[0-9]+', '<n>', 'g') END"""


def op7_sql(rules: list[Rule], number: str, levels: int = 24, t: TreeSettings = TreeSettings()) -> str:
    """The tree of the supplied pages, a group by a level: SQL has no loop that groups, so there are ``levels`` of them, more than the pages have."""
    steps = []
    for k in range(levels):
        steps.append(f"""c{k} AS MATERIALIZED (SELECT host, template, segs[{k + 1}] AS child, sum(n) AS n, sum(l) AS l, sum(g) AS g, count(*) AS forms FROM p{k} GROUP BY ALL),
d{k} AS (SELECT host, template, sum(n) AS nn, count(*) AS kinds, count(*) FILTER (n < {t.repeats}) AS rare, sum(l) AS nl, sum(g) AS ng FROM c{k} GROUP BY ALL),
e{k} AS (SELECT c.*, kinds, rare, ng / nullif(nl, 0) AS pooled, abs(g / nullif(l, 0) - (ng - g) / nullif(nl - l, 0)) AS gap, 1 / nullif(l, 0) + 1 / nullif(nl - l, 0) AS parts FROM c{k} c JOIN d{k} d ON c.host = d.host AND c.template = d.template),
f{k} AS MATERIALIZED (SELECT host, template, child, forms, CASE WHEN (rare >= {t.many} AND n < {t.repeats}) OR (kinds > 1 AND coalesce(sqrt(pooled * (1 - pooled) * parts) = 0 OR gap < {t.z} * sqrt(pooled * (1 - pooled) * parts), true)) THEN '*' ELSE child END AS goal FROM e{k}),
g{k} AS MATERIALIZED (SELECT p.host, p.segs, p.n, p.l, p.g, forms = 1 AND goal = f.child AND f.child <> '*' AS alone, list_concat(p.template, [goal]) AS way FROM p{k} p JOIN f{k} f ON p.host = f.host AND p.template = f.template AND segs[{k + 1}] = f.child),
r{k} AS MATERIALIZED (SELECT host, segs, n, l, g, CASE WHEN alone THEN list_concat(way, segs[{k + 2}:]) ELSE way END AS template FROM g{k} WHERE alone OR len(segs) <= {k + 1}),
p{k + 1} AS MATERIALIZED (SELECT host, segs, n, l, g, way AS template FROM g{k} WHERE NOT alone AND len(segs) > {k + 1})""")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    cases = lambda value: " ".join(f"WHEN (w.host = '{r.host}' OR ends_with(w.host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered)
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
told AS (SELECT page_id, count(*) AS l, sum(quality) AS g FROM v JOIN labels ON doc_id = TRY_CAST(nullif(regexp_extract(path, '{number}', 1), '') AS BIGINT) WHERE quality IS NOT NULL GROUP BY page_id),
w AS MATERIALIZED (SELECT v.page_id, host, path, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: {_FORM}) AS segs, coalesce(l, 0) AS l, coalesce(g, 0) AS g FROM v LEFT JOIN told ON told.page_id = v.page_id),
p0 AS MATERIALIZED (SELECT host, segs, count(*) AS n, sum(l) AS l, sum(g) AS g, CAST([] AS VARCHAR[]) AS template FROM w GROUP BY host, segs),
{", ".join(steps)},
a AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(levels))}),
h AS (SELECT host, (sum(g) + {t.prior} * coalesce((SELECT sum(g) / nullif(sum(l), 0) FROM a), 1)) / (sum(l) + {t.prior}) AS share FROM a GROUP BY host),
q AS (SELECT a.host, a.template, (sum(g) + {t.prior} * any_value(share)) / (sum(l) + {t.prior}) AS purity FROM a JOIN h ON h.host = a.host GROUP BY a.host, a.template)
SELECT page_id, w.host, path, CASE {cases(lambda r: r.name)} END AS rule, CASE {cases(lambda r: r.verdict)} WHEN purity < {t.threshold} THEN 'block' ELSE 'allow' END AS verdict, concat('/', array_to_string(a.template, '/')) AS template, purity
FROM (SELECT page_id, host, path, segs FROM w) w JOIN a ON a.host = w.host AND a.segs = w.segs JOIN q ON q.host = a.host AND q.template = a.template"""
