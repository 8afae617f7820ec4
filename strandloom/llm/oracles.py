"""DuckDB statements with the rows of the queries that SQL can express."""

from __future__ import annotations

from .infill import INFILL_SQL
from .manifest import manifest_sql
from .mixing import MIX_SQL
from .topk import TOP_K_SQL

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

#: Windows of ten words of items against all windows of documents.
WINDOW_HITS_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
units AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS u FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT m FROM units),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes),
stretches AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS u FROM places),
hits AS (SELECT doc_id, m, i, item_id FROM stretches JOIN units USING (m, u)),
inside AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Links by common two-word shingles over all pairs that share one, and what is reachable over them.
NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sn a JOIN sn b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

ORACLES = {
    "op1_near_duplicates": NEAR_DUPLICATES_SQL,
    "op6_decontaminate": WINDOW_HITS_SQL,
    "op9_mix_sources": MIX_SQL,
    "op11_exact_top_k": TOP_K_SQL,
    "op12_merkle_manifest": manifest_sql(),
    "op13_fill_in_middle": INFILL_SQL,
}
