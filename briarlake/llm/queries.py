"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_warc": "warc",
    "op2_toxicity": "toxicity",
    "op3_near_dup": "near_dup",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_packing": "packing",
    "op6_pii": "pii",
    "op7_html": "html_extract",
    "op8_media_gif": "media_gif",
    "op9_quality": "quality",
    "op10_decontamination": "decontam",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"briarlake.llm.{module}"), name) for name, module in _QUERIES.items()}


_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(('0x' || substr(p.h, CAST(5 * k + 1 AS BIGINT), 5))::BIGINT // CAST(pow(2, s) AS BIGINT) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN p.page_id = f.first OR f.first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f USING (h)
"""

_NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], chr(31)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
root AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root r ON r.doc_id = d.doc_id
"""

_SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS h, hash('b' || substr(x, 2 * i + 1, 800)) AS h2 FROM (SELECT doc_id, x, unnest(range(0, CAST(len(x) // 2 - 399 AS BIGINT))) AS i FROM t WHERE len(x) >= 800)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h, h2) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS new FROM r),
k AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
runs AS (SELECT doc_id, k, min(i) AS s, max(i) + 400 AS e FROM k GROUP BY 1, 2),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs),
agg AS (SELECT c.doc_id, CAST(sum(c.e - c.s) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(t.x, 2 * c.before + 1, 2 * (c.s - c.before)), '' ORDER BY c.s) || substr(any_value(t.x), 2 * max(c.e) + 1) AS kept
  FROM cuts c JOIN t ON t.doc_id = c.doc_id GROUP BY 1)
SELECT t.doc_id, CAST(len(t.x) // 2 AS BIGINT) AS n_bytes, coalesce(a.n_removed, 0) AS n_removed, coalesce(a.n_spans, 0) AS n_spans, sha256(unhex(coalesce(a.kept, t.x))) AS kept_sha256
FROM t LEFT JOIN agg a ON a.doc_id = t.doc_id
"""

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _WARC, "op3_near_dup": _NEAR_DUP, "op4_suffix_dedup": _SUFFIX_DEDUP, "op10_decontamination": _DECONTAMINATION}
