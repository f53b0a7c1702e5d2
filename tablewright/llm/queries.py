"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.backoff import score_texts
from tablewright.llm.decontamination import matches
from tablewright.llm.extraction import extract_pages
from tablewright.llm.fill_in_middle import fill_in_middle
from tablewright.llm.mixing import mix_documents
from tablewright.llm.near_duplicates import deduplicated
from tablewright.llm.quality_rules import filter_documents
from tablewright.llm.repeats import removal_digests
from tablewright.llm.rule_ensemble import score_documents
from tablewright.llm.secret_scan import scan_documents
from tablewright.llm.sharding import shard_documents
from tablewright.llm.token_alignment import align_tokenizers
from tablewright.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, tables: str, sql: str | None = None):
    """Registers a function of one or more tables."""

    def add(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables.split()])
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_query("op1_mix_sources", "documents", r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, most / weight AS fills_at FROM w),
r AS (SELECT *, coalesce(sum(most) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM f),
l AS (SELECT *, (budget - before) / open_weight AS level FROM r),
h AS (SELECT arg_min(level, fills_at) AS level FROM l WHERE level <= fills_at),
t AS (SELECT source, source_size, CASE WHEN h.level IS NULL THEN most ELSE least(most, h.level * weight) END AS target FROM l CROSS JOIN h),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(1, floor(target / source_size)) END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.place) AS inside
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= budget OR (upto - inside < budget AND upto - budget <= budget - (upto - inside)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""")(mix_documents)

_query("op2_quality_rules", "documents labels")(filter_documents)

_query("op3_archive_pages", "pages", """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, url
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest""")(archive_pages)

_query("op4_secret_scan", "documents")(scan_documents)

_query("op5_repeated_strings", "documents")(removal_digests)

_query("op6_main_text", "pages")(extract_pages)

_query("op7_quality_classifier", "documents labels")(score_documents)

_query("op8_near_duplicates", "documents", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingles FROM w),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.shingles) + len(q.shingles) - n)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON m.node = s.doc_id""")(deduplicated)

_query("op9_benchmark_matches", "documents benchmark")(matches)

_query("op10_shard_documents", "documents")(shard_documents)

_query("op11_align_tokenizers", "documents")(align_tokenizers)

_query("op12_katz_scores", "documents")(score_texts)

_query("op13_fill_in_middle", "documents", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST(len(units) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k - 7, 8) AS BIGINT) FOR k IN [1, 2, 3, 4]] AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")(fill_in_middle)
