"""DuckDB twins of the corpus queries that SQL can state."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# CRC-32 of the decimal form of every value of {column}, bit by bit.
CRC = """
bits AS (
    SELECT DISTINCT {column} AS id, {column}::VARCHAR AS s, 0 AS k, 4294967295 AS c FROM {table} WHERE {column} IS NOT NULL
    UNION ALL
    SELECT id, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
    FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])) ELSE c END AS x FROM bits WHERE k < 8 * length(s))
),
crc AS (SELECT id, 4294967295 - c AS h FROM bits WHERE k = 8 * length(s))"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Equal words p apart, in unbroken stretches, for each period p.
ORACLES["op11_periodic_runs"] = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),{CRC.format(column="doc_id", table="documents")},
shape AS (SELECT r, docs.doc_id, w, len(w) AS n, coalesce(h % 10 = 0 AND len(w) > 0, false) AS made, h // 10 AS g FROM docs LEFT JOIN crc ON docs.doc_id = crc.id),
start AS (SELECT *, CASE WHEN made THEN g % n END AS a FROM shape),
period AS (SELECT *, CASE WHEN made THEN 1 + (n - a) // (3 + g % 8) END AS q FROM start),
texts AS (SELECT r, doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % q END + 1]) ELSE w END AS w FROM period),
words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM texts),
grams AS (SELECT r, n, i, hash(w, lead(w, 1) OVER t, lead(w, 2) OVER t) AS gram FROM words WINDOW t AS (PARTITION BY r ORDER BY i)),
inner_grams AS (SELECT * FROM grams WHERE i + 3 <= n),
pairs AS (SELECT x.r, x.i, y.i - x.i AS p FROM inner_grams x JOIN inner_grams y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, p, min(i) AS s, count(*) + 2 + p AS l FROM islands GROUP BY r, p, island),
runs AS (SELECT r, s, l, min(p) AS p FROM stretches WHERE l >= greatest(6, 4 * p) GROUP BY r, s, l),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (SELECT words.r, string_agg(w, ' ' ORDER BY words.i) AS kept FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r),
told AS (
    SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p) AS lines,
           arg_min({{'s': s, 'l': l, 'p': p}}, {{'share': -(l::DOUBLE / p), 's': s, 'p': p}}) AS best
    FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

# Prefixes as lists of turns; sums over a subtree by joining every node with all nodes above it.
ORACLES["op12_prefix_trie"] = f"""
WITH RECURSIVE own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
),{CRC.format(column="conv_id", table="conversations")},
plan AS (SELECT id AS conv_id, h % 6 AS h, id - id % 100 AS head FROM crc),
lent AS (SELECT plan.conv_id, i, role, text FROM plan JOIN own ON own.conv_id = head AND i < h),
counts AS (SELECT conv_id, count(*) AS taken FROM lent GROUP BY conv_id),
kept AS (SELECT conv_id, i - h + coalesce(taken, 0) AS i, role, text FROM own JOIN plan USING (conv_id) LEFT JOIN counts USING (conv_id) WHERE i >= h),
turns AS (SELECT * FROM lent UNION ALL SELECT * FROM kept),
lengths AS (SELECT plan.conv_id, count(i) AS n FROM plan LEFT JOIN turns USING (conv_id) GROUP BY plan.conv_id),
steps AS (SELECT conv_id, i + 1 AS depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY i) AS prefix, length(text) AS size FROM turns),
prefixes AS (SELECT conv_id, 0 AS depth, []::STRUCT(role VARCHAR, text VARCHAR)[] AS prefix, 0 AS size FROM plan UNION ALL SELECT * FROM steps),
placed AS (SELECT prefixes.*, min(conv_id) OVER (PARTITION BY prefix) AS owner, depth = n AS ends FROM prefixes JOIN lengths USING (conv_id)),
nodes AS (
    SELECT owner, depth, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ends
    FROM placed GROUP BY owner, depth
),
parents AS (SELECT nodes.*, placed.owner AS parent FROM nodes LEFT JOIN placed ON placed.conv_id = nodes.owner AND placed.depth = nodes.depth - 1),
children AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT parents.*, coalesce(n_children, 0) AS n_children FROM parents LEFT JOIN children USING (owner, depth)),
sums AS (
    SELECT placed.owner, placed.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM whole JOIN placed ON placed.conv_id = whole.owner AND placed.depth <= whole.depth GROUP BY placed.owner, placed.depth
)
SELECT owner AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM whole JOIN sums USING (owner, depth)
"""

# Windows of thirteen words by their text, the smallest document of each, and the words that later ones cover.
ORACLES["op2_substring_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS said FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM docs) WHERE doc_id IS NOT NULL),
firsts AS (SELECT said, min(doc_id) AS doc_id FROM windows GROUP BY said),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM windows w JOIN firsts f ON f.said = w.said AND f.doc_id < w.doc_id),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

# All pairs of sound vectors with one label, and whatever they reach.
ORACLES["op5_embedding_dedup"] = """
WITH RECURSIVE sound AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (SELECT r, r AS at, vec_id AS id FROM sound UNION SELECT reached.r, links.b, links.id FROM reached JOIN links ON links.a = reached.at),
least AS (SELECT vec_id, min(reached.id) AS component_id, any_value(n) AS n FROM sound JOIN reached USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY a) USING (r) GROUP BY sound.r, vec_id)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN least ON least.vec_id = e.vec_id
"""

# Distinct runs of five words (all words of a shorter text) by their text, every pair that shares one, and whatever pairs reach.
ORACLES["op8_minhash"] = f"""
WITH RECURSIVE texts AS (SELECT DISTINCT doc_id, text FROM documents),
split AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM texts),
shingles AS (
    SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 5 THEN md5('short' || array_to_string(w, ' ')) ELSE md5(array_to_string(w[i:i + 4], ' ')) END AS shingle
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0 AND doc_id IS NOT NULL)
),
sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b, y.doc_id AS id FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE shared.n::DOUBLE / (x.n + y.n - shared.n) >= 0.8),
reached AS (SELECT r, r AS at, doc_id AS id FROM sizes UNION SELECT reached.r, links.b, links.id FROM reached JOIN links ON links.a = reached.at),
least AS (SELECT r, min(id) AS class_id FROM reached GROUP BY r)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_id, doc_id) = doc_id AS kept FROM split LEFT JOIN least USING (r)
"""
