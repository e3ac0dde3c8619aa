"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .counts import op9_token_counts
from .decontaminate import op10_decontaminate
from .jaccard import op1_jaccard_join
from .licenses import op3_licenses
from .quality import COUNTS_ORACLE as QUALITY_ORACLE
from .quality import op7_quality, quality_counts
from .substrings import op6_substrings
from .tokens import op4_token_files
from .urls import op8_url_filters
from .urls import oracle as urls_oracle
from .warc import op2_warc

QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_warc": op2_warc, "op3_licenses": op3_licenses, "op4_token_files": op4_token_files, "op8_url_filters": op8_url_filters, "op9_token_counts": op9_token_counts, "op5_bpe": op5_bpe, "op6_substrings": op6_substrings, "op7_quality": op7_quality, "quality_counts": quality_counts, "op10_decontaminate": op10_decontaminate}

ORACLES = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)),
r AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT id, min(seen) AS class_id FROM r GROUP BY 1),
d AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY 1),
t AS (SELECT doc_id, count(*) OVER (PARTITION BY m) AS n_copies FROM n)
SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM documents LEFT JOIN c ON c.id = documents.doc_id LEFT JOIN d ON d.id = documents.doc_id LEFT JOIN t ON t.doc_id = documents.doc_id
""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to
FROM d
""",
    "op8_url_filters": urls_oracle(),
    "quality_counts": QUALITY_ORACLE,
    "op6_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, j FROM r, unnest(range(i, i + 20)) AS t(j) WHERE k > 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(w[j], ' ' ORDER BY j) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) LEFT JOIN (SELECT doc_id, j, 1 AS x FROM gone) USING (doc_id, j) WHERE x IS NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM p),
o AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, lengths, unnest(range(1, len(w) - m + 2)) AS t(i)),
f AS (SELECT o.doc_id, o.i, o.m, p.item_id FROM o JOIN p USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM f, unnest(range(i, i + m)) AS t(j) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, 'null') AS x FROM f) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
