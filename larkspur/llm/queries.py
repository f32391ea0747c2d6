"""One thin query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from . import conversations, decontamination, html, jpeg, language, packing, pseudolikelihood, quality, ranking, rules, secrets, similarity, warc
from .kit import small_batches
from .kit import table as stored


def table(spark, sf_dir, name):
    return stored(small_batches(spark), sf_dir, name)


def op1_secrets(spark, sf_dir):
    return secrets.digest(secrets.spans(table(spark, sf_dir, "documents")))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard(spark, sf_dir):
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


def op5_jpeg(spark, sf_dir):
    return jpeg.round_trip(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


def op7_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_pseudolikelihood(spark, sf_dir):
    return pseudolikelihood.scored(table(spark, sf_dir, "documents"))


def op11_isolation(spark, sf_dir):
    return rules.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_signatures(spark, sf_dir):
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_threshold(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_packing, op3_quality, op4_ngram_jaccard, op5_jpeg, op6_language, op7_html, op8_decontamination, op9_warc, op10_pseudolikelihood, op11_isolation, op12_signatures, op13_threshold)}

# Words, as the operators take them: A-Z lowered; runs of digits, letters and all beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_ngram_jaccard": f"""
WITH RECURSIVE c AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep FROM documents GROUP BY 1),
w AS (SELECT rep, {_WORDS} AS w FROM c),
s AS (SELECT DISTINCT rep, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.rep = x JOIN n b ON b.rep = y WHERE k >= 0.8 * (a.n + b.n - k) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
g AS (SELECT x, least(x, min(y)) AS lead FROM r GROUP BY x),
t AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, coalesce(g.lead, rep) AS class_id, rep AS text_class, coalesce(n_links, 0) AS n_links
FROM documents d JOIN c ON coalesce(d.text, '') = c.text LEFT JOIN g ON g.x = rep LEFT JOIN t ON t.x = rep""",
    "op8_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT r, i, m, item_id FROM x JOIN p USING (m, g)),
k AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(h)) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > lead THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id > lead THEN lead END AS refers_to FROM d""",
    "op13_threshold": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
p AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, c GROUP BY term, n_docs),
s AS (SELECT i, item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // total))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), c GROUP BY i, item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0) WHERE rank <= 50""",
    # CRC-32 by its table; costs to come from the last turn to the first, then a walk forward.
    "op12_signatures": r"""
WITH RECURSIVE k AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM conversations, k),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS i, lag(role[1]) OVER w || role[1] AS pair, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM r),
f AS (SELECT *, last = '' AS blank, last <> '' AND seen > 1 AS duplicate, last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS truncated FROM o),
s AS (SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
v AS (SELECT conv_id, n AS i, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3 FROM s UNION ALL
 SELECT conv_id, i, least(r0, 2 + r2, 4 + r3), least(r1, 2 + r2, 4 + r3), least(r2, 2 + r3), least(r3, 2 + r2) FROM (SELECT v.conv_id, f.i,
 least(3 + v0, CASE WHEN gone THEN 99999999 WHEN l = 's' THEN least(e + v1, 2 + e + v2) WHEN l = 'u' THEN e + v2 ELSE 2 + e + v2 END) AS r0,
 least(3 + v1, CASE WHEN gone THEN 99999999 WHEN l = 'u' THEN e + v2 ELSE 2 + e + v2 END) AS r1,
 least(3 + v2, CASE WHEN gone THEN 99999999 WHEN l = 'a' THEN e + v3 ELSE 2 + e + v3 END) AS r2,
 least(3 + v3, CASE WHEN gone THEN 99999999 WHEN l = 'u' THEN e + v2 ELSE 2 + e + v2 END) AS r3
 FROM v JOIN (SELECT conv_id, i, blank OR duplicate AS gone, truncated::INT AS e, role[1] AS l FROM f) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1)),
p AS (SELECT a.conv_id, a.i, [a.v0, a.v1, a.v2, a.v3] AS here, [b.v0, b.v1, b.v2, b.v3] AS rest, blank OR duplicate AS gone, truncated::INT AS e, role, text FROM v a LEFT JOIN v b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i),
x AS (SELECT conv_id, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM s UNION ALL
 SELECT conv_id, i + (op <> 'I')::BIGINT, CASE op WHEN 'D' THEN q WHEN 'K' THEN kept ELSE [3, 3, 4, 3][q] END, audit || op, CASE op WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, ['user', 'user', 'assistant', 'user'][q] || ':' || CASE WHEN op = 'R' THEN text ELSE '' END) END
 FROM (SELECT *, CASE WHEN rest IS NOT NULL AND role IS NOT NULL AND 3 + rest[q] = here[q] THEN 'D' WHEN 2 + here[[3, 3, 4, 3][q]] = here[q] THEN 'I' WHEN kept IS NOT NULL AND NOT gone AND e + rest[kept] = here[q] THEN 'K' ELSE 'R' END AS op
 FROM (SELECT x.*, here, rest, gone, e, role, text, CASE WHEN q = 1 AND role[1] = 's' THEN 2 WHEN q <> 3 AND role[1] = 'u' THEN 3 WHEN q = 3 AND role[1] = 'a' THEN 4 END AS kept FROM x JOIN p ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.i = x.i WHERE role IS NOT NULL OR here[q] > 0))),
y AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM x GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.v0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 0 LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
