"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from ..ontology import ENTITY_TYPES, FORBIDDEN, INSTRUCTIONS, PREDICATE_ALIASES, SUBJECT_TYPES, TYPE_COLOURS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canon(x: str) -> str:
    low = rf"regexp_replace(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({low}, '^(the|a|an) ', ''), '^[ .,;:]+|[ .,;:]+$', '', 'g')"


_CASES = [
    "SELECT c_name, 'ORGANIZATION', 'located_in', n_name, 'LOCATION', (50 + c_custkey % 50)::DOUBLE / 100, 1000000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "SELECT s_name, 'ORGANIZATION', 'located_in', n_name, 'LOCATION', (30 + s_suppkey % 70)::DOUBLE / 100, 2000000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "SELECT n_name, 'LOCATION', 'part_of', r_name, 'LOCATION', 0.9::DOUBLE, 3000000000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey",
    "SELECT 'Order ' || l_orderkey, 'DOCUMENT', 'contains', p_name, 'PRODUCT', (35 + 5 * l_linenumber)::DOUBLE / 100, 4000000000000 + l_orderkey * 10 + l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey",
    "SELECT n_name, 'LOCATION', 'requires', c_name, 'PERSON', 0.8::DOUBLE, 5000000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0",
    "SELECT p_name, 'PRODUCT', 'regulates', p_brand, 'CONCEPT', 0.8::DOUBLE, 6000000000000 + p_partkey FROM part WHERE p_partkey % 20 = 0",
    "SELECT s_name, 'ORGANIZATION', 'affiliated_with', 'x', 'ORGANIZATION', 0.8::DOUBLE, 7000000000000 + s_suppkey FROM supplier WHERE s_suppkey % 7 = 0",
    "SELECT r_name, 'LOCATION', 'related_to', lower(r_name), 'LOCATION', 0.8::DOUBLE, 8000000000000 + r_regionkey FROM region",
    "SELECT s_name, 'ENTITY', 'related_to', 'the market', 'CONCEPT', 0.8::DOUBLE, 9000000000000 + s_suppkey FROM supplier WHERE s_suppkey % 9 = 0",
    "SELECT 'The ' || s_name || '.', 'PERSON', 'related_to', 'the market', 'CONCEPT', 0.7::DOUBLE, 10000000000000 + s_suppkey FROM supplier WHERE s_suppkey % 5 = 0",
]
STAR = "star(subject, subject_type, predicate, target, target_type, confidence, seq) AS (" + " UNION ALL ".join(_CASES) + ")"
_TYPES = ", ".join(map(_q, ENTITY_TYPES))
_BAD = ", ".join(_q("|".join(f)) for f in FORBIDDEN)
_SUBJECT = " AND ".join(f"(predicate <> {_q(p)} OR subject_type IN ({', '.join(map(_q, t))}))" for p, t in SUBJECT_TYPES.items())
RULED = f"""{STAR}, ruled AS (SELECT *, CASE
  WHEN subject_type NOT IN ({_TYPES}) OR target_type NOT IN ({_TYPES}) THEN 'dropped_sitl_type_enum'
  WHEN subject_type || '|' || predicate || '|' || target_type IN ({_BAD}) THEN 'dropped_sitl_combo'
  WHEN NOT ({_SUBJECT}) THEN 'dropped_sitl_subject_type'
  WHEN length(trim(subject)) < 2 OR length(trim(target)) < 2 THEN 'dropped_sitl_too_short'
  WHEN lower(subject) = lower(target) THEN 'dropped_sitl_self_loop' END AS drop_reason FROM star)"""
AGG = f"""{RULED}, tri AS (SELECT *, {_canon('subject')} AS s, {_canon('target')} AS t FROM ruled WHERE drop_reason IS NULL),
agg AS (SELECT s, predicate, t, avg(confidence) AS confidence, count(*) AS count, min(seq) AS seq, arg_min(subject, seq) AS subject,
  arg_min(subject_type, seq) AS subject_type, arg_min(target, seq) AS target, arg_min(target_type, seq) AS target_type FROM tri GROUP BY s, predicate, t)"""
EDGES = f"{AGG}, edges AS (SELECT * FROM agg WHERE confidence >= 0.4)"
ENDS = f"""{EDGES}, ends AS (SELECT s AS id, subject AS label, subject_type AS type, seq, 0 AS side FROM edges
  UNION ALL SELECT t, target, target_type, seq, 1 FROM edges),
nodes AS (SELECT id, min(label) AS label, min(type) AS type FROM ends GROUP BY id),
deg AS (SELECT id, sum(1 - side)::BIGINT AS out_degree, sum(side)::BIGINT AS in_degree, count(*) AS degree FROM ends GROUP BY id)"""


def _ranks(iterations: int) -> str:
    out = [f"""{ENDS}, flat AS MATERIALIZED (SELECT s, t, min(confidence) AS w FROM edges GROUP BY s, t),
tot AS (SELECT s, sum(w) AS total FROM flat GROUP BY s),
link AS MATERIALIZED (SELECT flat.s, t, w / total AS share FROM flat JOIN tot ON flat.s = tot.s),
n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
pr0 AS (SELECT id, tot.s IS NOT NULL AS has, 1.0::DOUBLE / n AS r FROM nodes LEFT JOIN tot ON id = tot.s, n)"""]
    for i in range(iterations):
        out.append(f"""pr{i + 1} AS MATERIALIZED (SELECT p.id, p.has, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM pr{i} WHERE NOT has) / n) AS r
  FROM pr{i} p LEFT JOIN (SELECT t, sum(r * share) AS g FROM link JOIN pr{i} ON id = s GROUP BY t) x ON x.t = p.id, n)""")
    return ",\n".join(out)


RANKS = _ranks(10)
SENTS = r"""sents AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents))"""
TOKENS = r"CAST(floor(len(list_filter(string_split_regex(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER)"
PAGES = "pages0 AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations)"
SECTION = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 80"
RUNS = "runs AS (SELECT user_id AS chunk_id, event_id % 5 AS run_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS subject, event_id AS seq FROM events)"
ORDERED = "o AS (SELECT l_orderkey AS chunk_id, 'Order ' || l_orderkey AS subject, p_name AS target, l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)"
ALIAS = "al(label, leader) AS (VALUES ('FRANCE', 'GERMANY'), ('RUSSIA', 'GERMANY'), ('CHINA', 'INDIA'), ('NATION_1', 'NATION_0'), ('NATION_3', 'NATION_2'))"
ALIASED = f"""{EDGES}, {ALIAS}, rew AS (SELECT coalesce(a.leader, subject) AS subject, subject_type, predicate, coalesce(b.leader, target) AS target, target_type, confidence, count, seq
  FROM edges LEFT JOIN al a ON a.label = subject LEFT JOIN al b ON b.label = target)"""
MENTIONS = rf"""{SENTS}, ment AS (SELECT doc_id, sent, unnest(l) AS label, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT doc_id, pos AS sent, list_filter(string_split_regex(sentence, '\s+'), lambda w: length(w) > 1) AS l FROM sents))"""
NEAR = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_NAMES = [*PREDICATE_ALIASES, "related_to", "Works At ", " CREATED BY"]
_ALIAS_ROWS = ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(_NAMES))
_CANON_ROWS = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in PREDICATE_ALIASES.items())
_COLOURS = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in TYPE_COLOURS.items())
_MOD = "SELECT c_custkey::BIGINT AS chunk_id, c_custkey % 8 AS m FROM customer"

MISSING = f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nbr_id, {NEAR} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr_id) AS k FROM p WHERE sim >= 0.35),
u AS (SELECT least(id, nbr_id) AS src_id, greatest(id, nbr_id) AS dst_id, max(sim) AS sim FROM r WHERE k <= 8 GROUP BY 1, 2),
e AS (SELECT DISTINCT least(vec_id, (vec_id * 7 + 3) % 100) AS x, greatest(vec_id, (vec_id * 7 + 3) % 100) AS y FROM embeddings)
SELECT src_id, dst_id, round(sim, 6) AS sim FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE x = src_id AND y = dst_id) ORDER BY u.sim DESC, src_id, dst_id LIMIT 5000"""

ORACLE = {
    "sections_from_toc": f"""WITH {PAGES}, toc AS (SELECT doc_id, page_no // 3 AS section_no, 'T' || page_no AS title, page_no AS lo,
  lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS hi FROM pages0 WHERE page_no % 3 = 0),
s AS (SELECT p.doc_id, section_no::INTEGER AS section_no, title, string_agg(text, chr(10) ORDER BY p.page_no) AS text FROM pages0 p JOIN toc ON p.doc_id = toc.doc_id AND p.page_no >= lo AND (hi IS NULL OR p.page_no < hi) GROUP BY ALL)
SELECT * FROM s WHERE {SECTION}""",
    "sections_fixed_blocks": f"""WITH {PAGES}, m AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last FROM pages0),
s AS (SELECT doc_id, (page_no // 3)::INTEGER AS section_no, 'pages_' || (page_no // 3 * 3 + 1) || '_' || least(page_no // 3 * 3 + 3, last + 1) AS title, string_agg(text, chr(10) ORDER BY page_no) AS text FROM m GROUP BY ALL)
SELECT doc_id, section_no, title, text FROM s WHERE {SECTION}""".replace("FROM m GROUP BY ALL", "FROM m GROUP BY doc_id, page_no // 3, last"),
    "sparse_document_flag": "SELECT doc_id, avg(length(text)) < 200 AS is_sparse FROM documents GROUP BY doc_id",
    "metrics_text_parse": "SELECT event_id, 'events_total' AS name, event_type AS type, user_id::VARCHAR AS user, event_id::DOUBLE AS value FROM events",
    "sentence_split": f"WITH {SENTS} SELECT doc_id, pos::INTEGER AS pos, sentence FROM sents",
    "sentence_token_counts": f"WITH {SENTS} SELECT doc_id, pos::INTEGER AS pos, {TOKENS} AS n_tokens FROM sents",
    "chunk_batches": f"""WITH {SENTS}, k AS (SELECT doc_id, sentence AS text, {TOKENS} AS n_tokens FROM sents)
SELECT doc_id, n_tokens, text, (row_number() OVER (PARTITION BY doc_id ORDER BY n_tokens, text) - 1) // 8 AS batch FROM k""",
    "prompt_build": f"""WITH k AS (SELECT doc_id, text, list_transform(range(1, doc_id % 15 + 2), lambda i: 'entity ' || i) AS known FROM documents)
SELECT doc_id, md5({_q(INSTRUCTIONS)} || chr(10) || chr(10) || text || CASE WHEN len(known) > 5 THEN chr(10) || chr(10) || 'Known entities: ' || array_to_string(list_slice(known, 1, 12), ', ') ELSE '' END || chr(10) || chr(10) || 'JSON:') AS prompt_md5 FROM k""",
    "domain_classify": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
d AS (SELECT vec_id AS id, c.label, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS k FROM d)
SELECT id, label::VARCHAR AS label, round(s, 6) AS score FROM r WHERE k = 1""",
    "domain_histogram": "SELECT doc_id % 8 AS batch, coalesce(CASE WHEN lang <> 'es' THEN lang END, 'unclassified') AS label, count(*) AS n FROM documents GROUP BY 1, 2",
    "json_triples_parse": f"""WITH k AS ({_MOD}), r(m, pos, subject, predicate, target, drop_reason) AS (VALUES
  (0, 0, NULL, NULL, NULL, 'dropped_json_parse_error'), (2, 0, NULL, NULL, NULL, 'dropped_schema_invalid'), (3, 0, NULL, NULL, NULL, 'dropped_schema_invalid'),
  (4, 0, NULL, NULL, NULL, 'dropped_schema_invalid'), (5, 0, 'Acme', 'develops', 'Widget', NULL), (5, 1, 'Widget', 'part_of', 'Machine', NULL),
  (6, 0, '', 'part_of', 'Machine', 'dropped_missing_field'), (6, 1, 'Acme', 'develops', 'x', NULL), (7, 0, 'Acme', 'develops', 'Widget', NULL))
SELECT chunk_id, pos::BIGINT AS pos, CASE WHEN subject = 'Acme' THEN 'Acme ' || chunk_id ELSE subject END AS subject, predicate, target, drop_reason FROM k JOIN r ON k.m = r.m""",
    "entity_shape_filter": r"""WITH n AS (SELECT 'd' || doc_id AS key, text AS name FROM documents UNION ALL SELECT 'p' || p_partkey, p_name FROM part)
SELECT key, length(name) > 1 AND length(name) <= 80 AND len(list_filter(string_split_regex(regexp_replace(name, '^_+|_+$', '', 'g'), '[\s_]+'), lambda w: w <> '')) <= 7
  AND NOT regexp_matches(name, '\([0-9]{4}\)') AND NOT regexp_matches(name, '[.!?;][^.!?;]*[.!?;]') AS ok FROM n""",
    "schema_conformance": f"SELECT chunk_id, m IN (3, 6) AS ok FROM ({_MOD})",
    "toon_parse": """SELECT p_partkey, pos::BIGINT AS pos, s_name AS subject, 'ORGANIZATION' AS subject_type, 'supplies' AS predicate, p_name || '''s kind' AS target, 'PRODUCT' AS target_type, 0.95::DOUBLE AS confidence
FROM part JOIN supplier ON p_partkey % 50 + 1 = s_suppkey, range(2) r(pos)""",
    "toon_fallback": """SELECT p_partkey, pos::BIGINT AS pos, s_name AS subject, 'ENTITY' AS subject_type, 'supplies' AS predicate, p_name || '''s kind' AS target, 'ENTITY' AS target_type, 0.8::DOUBLE AS confidence
FROM part JOIN supplier ON p_partkey % 50 + 1 = s_suppkey, range(2) r(pos)""",
    "predicate_normalize": f"""WITH a(i, name) AS (VALUES {_ALIAS_ROWS}), c(k, v) AS (VALUES {_CANON_ROWS})
SELECT event_id, coalesce(v, replace(trim(lower(name)), ' ', '_')) AS predicate FROM events JOIN a ON i = event_id % {len(_NAMES)} LEFT JOIN c ON k = replace(trim(lower(name)), ' ', '_')""",
    "sitl_filter": f"WITH {RULED} SELECT seq, subject, predicate, target, drop_reason FROM ruled",
    "drop_reason_counts": f"WITH {RULED} SELECT drop_reason, count(*) AS n FROM ruled WHERE drop_reason IS NOT NULL GROUP BY 1",
    "logprob_confidence": "SELECT user_id, round(coalesce(least(1.0, exp(8 * avg(CASE WHEN event_id % 7 <> 0 THEN -value / 1000 END))), 0.75), 8) AS confidence FROM events GROUP BY user_id",
    "cooccurrence_enrich": f"""WITH {ORDERED}, t AS (SELECT chunk_id, subject, target, min(seq) AS seq FROM o GROUP BY ALL),
b AS (SELECT chunk_id FROM t GROUP BY 1 HAVING count(*) >= 2),
e AS (SELECT chunk_id, e, min(p) AS p FROM (SELECT chunk_id, subject AS e, seq * 2 AS p FROM t UNION ALL SELECT chunk_id, target, seq * 2 + 1 FROM t) JOIN b USING (chunk_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY p, e) AS k FROM e), c AS (SELECT * FROM r WHERE k <= 5)
SELECT x.chunk_id, x.e AS subject, 'related_to' AS predicate, y.e AS target, 0.65::DOUBLE AS confidence FROM c x JOIN c y ON x.chunk_id = y.chunk_id AND x.k < y.k
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.chunk_id = x.chunk_id AND ((t.subject = x.e AND t.target = y.e) OR (t.subject = y.e AND t.target = x.e)))""",
    "cooccurrence_uncapped": f"""WITH {ORDERED}, t AS (SELECT chunk_id, subject, target, min(seq) AS seq FROM o GROUP BY ALL),
c AS (SELECT chunk_id, lower(subject || ': ' || coalesce(string_agg(target, '; ' ORDER BY target) FILTER (seq % 2 = 1), '')) AS low FROM t GROUP BY chunk_id, subject HAVING count(*) >= 2),
e AS (SELECT chunk_id, e, min(p) AS p FROM (SELECT chunk_id, subject AS e, seq * 2 AS p FROM t UNION ALL SELECT chunk_id, target, seq * 2 + 1 FROM t) GROUP BY ALL),
k AS (SELECT e.*, row_number() OVER (PARTITION BY e.chunk_id ORDER BY p, e) AS k FROM e JOIN c ON e.chunk_id = c.chunk_id AND contains(low, lower(e)))
SELECT x.chunk_id, x.e AS subject, 'related_to' AS predicate, y.e AS target, 0.65::DOUBLE AS confidence FROM k x JOIN k y ON x.chunk_id = y.chunk_id AND x.k < y.k
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.chunk_id = x.chunk_id AND ((t.subject = x.e AND t.target = y.e) OR (t.subject = y.e AND t.target = x.e)))""",
    "resample_chunks": "SELECT o_orderkey AS chunk_id, r::INTEGER AS run_id FROM orders, range(3) x(r)",
    "two_pass_extraction": """WITH c AS (SELECT n_nationkey::BIGINT AS chunk_id, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 3)
SELECT chunk_id, 1::INTEGER AS step, n AS subject, 'part_of' AS predicate, r AS target, 0.9::DOUBLE AS confidence FROM c
UNION ALL SELECT chunk_id, 1, 'Trade', 'depends_on', 'Law', 0.9 FROM c
UNION ALL SELECT chunk_id, 1, e, 'related_to', x, 0.65 FROM c, (VALUES ('Trade'), ('Law')) v(x), LATERAL (SELECT n AS e UNION ALL SELECT r) q
UNION ALL SELECT chunk_id, 2, r, 'contains', n, 0.9 FROM c WHERE chunk_id > 5 AND chunk_id % 5 <> 2""",
    "low_yield_chunks": f"WITH {ORDERED}, n AS (SELECT chunk_id, count(*) AS n FROM o GROUP BY 1) SELECT o_orderkey AS chunk_id, coalesce(n, 0)::BIGINT AS n_triples FROM orders LEFT JOIN n ON chunk_id = o_orderkey WHERE coalesce(n, 0) < 3",
    "consensus_vote": f"""WITH {RUNS} SELECT chunk_id, arg_min(subject, run_id * 1000000000 + seq) AS subject, 'related_to' AS predicate, 'Site' AS target, count(DISTINCT run_id) AS votes, round((count(DISTINCT run_id) + 2)::DOUBLE / 8, 8) AS confidence
FROM runs GROUP BY chunk_id, lower(subject) HAVING count(DISTINCT run_id) >= 5""",
    "rerun_replace": f"""WITH {RUNS}, n AS (SELECT chunk_id, count(*) FILTER (run_id < 2) AS a, count(*) FILTER (run_id >= 2 AND seq % 3 <> 0) AS b FROM runs GROUP BY 1)
SELECT chunk_id, CASE WHEN b > 0 AND b >= a THEN 'new' ELSE 'old' END AS run, CASE WHEN b > 0 AND b >= a THEN b ELSE a END AS n FROM n WHERE a > 0 OR b > 0""",
    "running_entities": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS batch, user_id || ':' || event_type AS entity FROM events),
f AS (SELECT b AS batch, count(*) AS n FROM (SELECT min(batch) AS b FROM e GROUP BY entity) GROUP BY 1), a AS (SELECT DISTINCT batch FROM e)
SELECT batch, coalesce(n, 0)::BIGINT AS new, (sum(coalesce(n, 0)) OVER (ORDER BY batch))::BIGINT AS seen FROM a LEFT JOIN f USING (batch)""",
    "canonical_labels": f"WITH k AS (SELECT doc_id, '  The  ' || text || ' . ' AS x FROM documents) SELECT doc_id, {_canon('x')} AS label FROM k",
    "triple_aggregate": f"WITH {AGG} SELECT subject, predicate, target, round(confidence, 8) AS confidence, count FROM agg",
    "alias_rewrite": f"WITH {ALIASED} SELECT subject, predicate, target, count(*) AS n FROM rew GROUP BY ALL",
    "edge_reaggregate": f"""WITH {ALIASED}, c AS (SELECT {_canon('subject')} AS subject, predicate, {_canon('target')} AS target, confidence, count FROM rew)
SELECT subject, predicate, target, round(avg(confidence), 8) AS confidence, sum(count)::BIGINT AS count FROM c GROUP BY subject, predicate, target""",
    "reaggregate_sources": f"""WITH {ALIASED}, c AS (SELECT {_canon('subject')} AS subject, predicate, {_canon('target')} AS target, confidence, count, seq FROM rew)
SELECT subject, predicate, target, round(sum(confidence * count) / sum(count), 8) AS confidence, sum(count)::BIGINT AS count, CASE WHEN min(seq) % 3 = 0 THEN 'extracted' ELSE 'co_occurrence' END AS edge_source
FROM c GROUP BY subject, predicate, target""",
    "batch_confidence": f"WITH {RULED} SELECT seq // 1000000000000 AS batch, count(*) AS n_triples, round(avg(confidence), 8) AS mean_confidence FROM ruled WHERE drop_reason IS NULL GROUP BY 1",
    "node_view": f"WITH {ENDS} SELECT label, type FROM nodes",
    "first_mentions": f"WITH {ENDS}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, side) AS k FROM ends) SELECT label, type FROM f WHERE k = 1",
    "graph_summary": f"WITH {ENDS} SELECT count(*) AS n_edges, count(DISTINCT predicate) AS n_predicates, (SELECT count(DISTINCT label) FROM ends) AS n_nodes, round(avg(confidence), 8) AS mean_confidence FROM edges",
    "entity_type_counts": f"WITH {ENDS} SELECT type, count(*) AS n FROM ends GROUP BY 1",
    "degree_summary": f"WITH {ENDS} SELECT round(avg(degree), 8) AS avg_degree, max(degree) AS max_degree FROM deg",
    "community_counts": f"WITH {ENDS} SELECT count(DISTINCT type) AS n_communities FROM nodes WHERE type IN ('PRODUCT', 'DOCUMENT', 'LOCATION')",
    "entity_similarities": """WITH n AS (SELECT DISTINCT p_name AS p FROM part), w AS (SELECT p, list_distinct(string_split(lower(p), ' ')) AS w FROM n),
j AS (SELECT a.p AS a, b.p AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u FROM w a JOIN w b ON a.p < b.p),
s AS (SELECT a, b, round(0.4::DOUBLE * (i::DOUBLE / u) + 0.6::DOUBLE * (1 - levenshtein(lower(a), lower(b))::DOUBLE / greatest(length(a), length(b))), 8) AS similarity FROM j WHERE i > 0)
SELECT * FROM s WHERE similarity >= 0.55""",
    "majority_type": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) WHERE k = 1",
    "majority_label": "WITH n AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS k FROM n) WHERE k = 1",
    "vote_join_back": f"""WITH {ENDS}, l AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS k FROM ends GROUP BY id, label),
y AS (SELECT id, type, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, type) AS k FROM ends GROUP BY id, type),
v AS (SELECT l.id, label, type FROM l JOIN y ON l.id = y.id AND l.k = 1 AND y.k = 1)
SELECT a.label AS subject, a.type AS subject_type, predicate, b.label AS target, b.type AS target_type, count(*) AS n FROM edges JOIN v a ON a.id = s JOIN v b ON b.id = t GROUP BY ALL""",
    "knn_search": f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nbr_id, {NEAR} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr_id) AS INTEGER) AS rank FROM p) SELECT id, rank, nbr_id, round(sim, 6) AS sim FROM r WHERE rank <= 5""",
    "index_search": f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nbr_id, {NEAR} / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr_id) AS INTEGER) AS rank FROM p WHERE sim >= 0.2) SELECT id, rank, nbr_id, round(sim, 6) AS sim FROM r WHERE rank <= 5""",
    "nearest_to_query": f"SELECT a.vec_id AS id, round({NEAR}, 6) AS sim FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {NEAR} DESC, id LIMIT 10",
    "missing_edges": MISSING,
    "edge_proposals": f"""WITH old AS (SELECT vec_id AS a, (vec_id * 7 + 3) % 100 AS b FROM embeddings), kind AS (SELECT DISTINCT i, CASE WHEN i % 4 = 0 THEN 'PRODUCT' ELSE 'CONCEPT' END AS k FROM (SELECT a AS i FROM old UNION SELECT b FROM old)),
new AS ({MISSING}) SELECT a AS src_id, b AS dst_id, 'related_to' AS predicate, 0.5::DOUBLE AS confidence, 1::BIGINT AS count, 'v' || a AS subject, x.k AS subject_type, 'v' || b AS target, y.k AS target_type, 'extracted' AS edge_source FROM old JOIN kind x ON x.i = a JOIN kind y ON y.i = b
UNION ALL SELECT src_id, dst_id, 'semantically_similar_to', sim, 1, 'v' || src_id, x.k, 'v' || dst_id, y.k, 'semantic_similarity' FROM new JOIN kind x ON x.i = src_id JOIN kind y ON y.i = dst_id""",
    "type_aware_ids": f"WITH {STAR} SELECT subject AS label, subject_type AS type, count(*) AS n FROM star GROUP BY 1, 2",
    "in_out_degree": f"WITH {ENDS} SELECT label, in_degree, out_degree, degree FROM nodes JOIN deg USING (id)",
    "pagerank": f"WITH {RANKS} SELECT label, round(r, 10) AS pagerank FROM nodes JOIN pr10 USING (id)",
    "modularity": f"""WITH {ENDS}, g AS (SELECT id, CASE WHEN type IN ('PRODUCT', 'DOCUMENT') THEN 1 ELSE 2 END AS c FROM nodes),
f AS (SELECT least(s, t) AS u, greatest(s, t) AS v, min(confidence) AS w FROM edges GROUP BY 1, 2), m AS (SELECT sum(w) AS m FROM f),
j AS (SELECT a.c AS cu, b.c AS cv, w FROM f JOIN g a ON a.id = u JOIN g b ON b.id = v),
d AS (SELECT c, sum(w) AS d FROM (SELECT cu AS c, w FROM j UNION ALL SELECT cv, w FROM j) GROUP BY c), i AS (SELECT cu AS c, sum(w) AS i FROM j WHERE cu = cv GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / m - (d / (2 * m)) ** 2), 8) AS modularity FROM d LEFT JOIN i USING (c), m""",
    "node_export": f"WITH {RANKS} SELECT label, type, round(r, 10) AS pagerank, in_degree, out_degree, -1::BIGINT AS community_id, degree FROM nodes JOIN pr10 USING (id) JOIN deg USING (id)",
    "hub_nodes": f"WITH {STAR} SELECT label, count(*) AS connections FROM (SELECT subject AS label FROM star UNION ALL SELECT target FROM star) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "topk_subgraph": f"""WITH {RANKS}, top AS (SELECT id FROM nodes JOIN pr10 USING (id) ORDER BY round(r, 9) DESC, label LIMIT 120)
SELECT subject, predicate, target FROM edges WHERE s IN (SELECT id FROM top) AND t IN (SELECT id FROM top)""",
    "topk_edges": f"WITH {EDGES} SELECT subject, predicate, target, round(confidence, 8) AS confidence FROM edges ORDER BY edges.confidence DESC, subject, predicate, target LIMIT 100",
    "vis_encoding": f"WITH {ENDS} SELECT label, 15 + 10 * degree AS size, CASE type {_COLOURS} ELSE '{TYPE_COLOURS['ENTITY']}' END AS colour, greatest(10, 10 + 3 * degree) AS node_size, least(6, 1 + degree) AS edge_width FROM nodes JOIN deg USING (id)",
    "sentence_cooccurrence": f"""WITH {MENTIONS}, name AS (SELECT * FROM ment WHERE regexp_matches(label, '^[A-Z]'))
SELECT a.label AS source, b.label AS target, 'co_occurs' AS relationship, count(*) AS weight
FROM name a JOIN name b ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.pos < b.pos AND a.label <> b.label GROUP BY 1, 2""",
    "mention_nodes": f"""WITH {MENTIONS} SELECT label, CASE WHEN regexp_matches(label, '^[A-Z]') THEN 'NAME' ELSE 'UNK' END AS type FROM ment GROUP BY label""",
    "svo_edges": f"""WITH {MENTIONS}, nm AS (SELECT doc_id, sent, list(label ORDER BY pos) AS names FROM ment WHERE regexp_matches(label, '^[A-Z]') GROUP BY 1, 2),
arc AS (SELECT a.doc_id, a.sent, a.pos, a.label AS s, v.label AS verb, o.label AS o FROM ment a JOIN ment v ON a.doc_id = v.doc_id AND a.sent = v.sent AND v.pos = a.pos + 1
  JOIN ment o ON a.doc_id = o.doc_id AND a.sent = o.sent AND o.pos = a.pos + 2 WHERE a.pos % 5 = 0),
grown AS (SELECT arc.doc_id, arc.sent, pos, lower(verb) AS verb, coalesce(list_filter(names, lambda m: contains(m, s))[1], s) AS source, coalesce(list_filter(names, lambda m: contains(m, o))[1], o) AS target
  FROM arc LEFT JOIN nm ON arc.doc_id = nm.doc_id AND arc.sent = nm.sent),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, target ORDER BY sent DESC, pos DESC) AS k FROM grown)
SELECT doc_id, source, target, verb AS relationship, 1::INTEGER AS weight FROM r WHERE k = 1""",
    "edge_export": f"WITH {EDGES} SELECT subject AS source_label, target AS target_label, predicate AS label, round(confidence, 8) AS weight, count, 'extracted' AS edge_source FROM edges",
    "node_files": f"WITH {ENDS} SELECT label, type, in_degree, out_degree, degree FROM nodes JOIN deg USING (id)",
    "checkpoint_files": "SELECT c_custkey AS id, c_name AS label FROM customer",
    "metric_rows": f"""WITH {ENDS}, m AS (SELECT count(*) AS n_edges, count(DISTINCT predicate) AS n_predicates, (SELECT count(DISTINCT label) FROM ends) AS n_nodes, avg(confidence) AS mean_confidence FROM edges)
SELECT 'graph_n_edges' AS name, n_edges::DOUBLE AS value FROM m UNION ALL SELECT 'graph_n_predicates', n_predicates FROM m UNION ALL SELECT 'graph_n_nodes', n_nodes FROM m UNION ALL SELECT 'graph_mean_confidence', round(mean_confidence, 8) FROM m""",
    "calibration_error": """WITH l AS (SELECT (doc_id * 37 % 101)::DOUBLE / 100 AS c, (quality = 1)::INTEGER AS ok FROM labels),
e(i, lo, hi) AS (VALUES (0, -1.0::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.2), (2, 0.2, 0.30000000000000004::DOUBLE), (3, 0.30000000000000004::DOUBLE, 0.4), (4, 0.4, 0.5), (5, 0.5, 0.6000000000000001::DOUBLE), (6, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE), (7, 0.7000000000000001::DOUBLE, 0.8), (8, 0.8, 0.9), (9, 0.9, 1.0)),
b AS (SELECT i, count(*) AS n, avg(c) AS c, avg(ok) AS a FROM l JOIN e ON c > lo AND c <= hi GROUP BY i)
SELECT round(sum(n::DOUBLE / (SELECT count(*) FROM l) * abs(c - a)), 8) AS error FROM b""",
    "completion_quality": f"""WITH k AS ({_MOD}), r(m, attempted, kept) AS (VALUES (0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 2, 2), (6, 1, 0), (7, 1, 1))
SELECT chunk_id, attempted::BIGINT AS attempted, kept::BIGINT AS kept, CASE WHEN attempted > 0 THEN kept::DOUBLE / attempted ELSE 0 END AS score FROM k JOIN r ON k.m = r.m""",
    "candidate_scores": """WITH r(m, attempted, kept) AS (VALUES (0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 2, 2), (6, 1, 0), (7, 1, 1))
SELECT c_custkey::BIGINT AS chunk_id, x::INTEGER AS setting, attempted::BIGINT AS attempted, kept::DOUBLE / attempted AS score FROM customer, range(4) s(x) JOIN r ON r.m = (c_custkey + x) % 8 WHERE attempted >= 2""",
    "preference_pairs": """WITH c AS (SELECT o_orderkey::VARCHAR AS prompt, o_orderkey || '-' || s AS completion, (o_orderkey + s) % 4 AS attempted, ((o_orderkey * 7 + s * 13) % 10)::DOUBLE / 10 AS score FROM orders, range(4) r(s)),
k AS (SELECT prompt, count(*) AS n, max(score) AS hi, min(score) AS lo FROM c WHERE attempted >= 2 GROUP BY 1 HAVING n >= 2 AND hi - lo >= 0.25)
SELECT k.prompt, (SELECT min(completion) FROM c WHERE c.prompt = k.prompt AND attempted >= 2 AND score = hi) AS chosen, (SELECT min(completion) FROM c WHERE c.prompt = k.prompt AND attempted >= 2 AND score = lo) AS rejected, hi AS chosen_score, lo AS rejected_score FROM k""",
    "rule_extraction": """SELECT n_nationkey::BIGINT AS chunk_id, pos::BIGINT AS pos, CASE pos WHEN 0 THEN n_name ELSE r_name END AS subject, CASE pos WHEN 0 THEN 'part_of' ELSE 'contains' END AS predicate, CASE pos WHEN 0 THEN r_name ELSE n_name END AS target, NULL::VARCHAR AS drop_reason
FROM nation JOIN region ON n_regionkey = r_regionkey, range(2) r(pos)""",
    "stream_triples": "SELECT 'user ' || user_id AS subject, event_type AS target, round(avg(least(1.0, value / 100)), 8) AS confidence, count(*) AS count FROM events GROUP BY 1, 2",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
ORACLE["preference_dataset"] = ORACLE["preference_pairs"]  # the same pairs, through files
