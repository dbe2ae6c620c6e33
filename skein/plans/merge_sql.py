"""The queries of canonical nodes and of conditions as SQL, written apart from the Spark plans."""

from __future__ import annotations

from skein.plans.star_sql import _G, _KEY, _PLAIN, _WORDS

_MAP = "CAST(map() AS MAP(VARCHAR, VARCHAR))"
FULL = f"""
full_nodes AS MATERIALIZED (SELECT id, type, label, CAST([] AS VARCHAR[]) AS synonyms, CAST([] AS VARCHAR[]) AS xrefs, {_MAP} AS attributes FROM nodes WHERE type NOT IN ('phenotype', 'disease', 'investigator')
  UNION ALL SELECT 'P:' || p_partkey, 'phenotype', p_name, [p_type, p_brand, p_name], ['sku:' || p_partkey], MAP {{'size': CAST(p_size AS VARCHAR), 'brand': p_brand}} FROM part
  UNION ALL SELECT 'S:' || s_suppkey, 'investigator', s_name, [lower(s_name)], CASE WHEN s_suppkey % 10 = 0 THEN ['s:' || (s_suppkey + 1)] ELSE [] END, MAP {{'nation': CAST(s_nationkey AS VARCHAR)}} FROM supplier
  UNION ALL SELECT 'N:' || n_nationkey, 'disease', n_name, [], [], MAP {{'region': CAST(n_regionkey AS VARCHAR)}} FROM nation
  UNION ALL SELECT 'ORPHA:' || n_nationkey, 'disease', 'the ' || lower(n_name), ['land ' || n_nationkey], [], MAP {{'region': '?', 'orpha': CAST(n_nationkey AS VARCHAR)}} FROM nation
  UNION ALL SELECT 'MONDO:' || n_nationkey, 'disease', 'State ' || n_nationkey, ['land ' || n_nationkey, upper(n_name)], ['orpha:' || n_nationkey], {_MAP} FROM nation)"""

#: Every key of a node leads to all nodes that have it; the smallest id that is reached names the group.
GROUPS = f"""{FULL},
w AS (SELECT id, type, {_KEY.format(_PLAIN)} AS content, {_WORDS.format(_PLAIN)} AS words, xrefs FROM full_nodes),
k AS (SELECT DISTINCT id, type, unnest([upper('i:' || id), 'l:' || array_to_string(CASE WHEN len(content) > 0 THEN content ELSE words END, ' ')] || list_transform(xrefs, lambda x: upper('i:' || x))) AS k FROM w),
star AS (SELECT id, min(id) OVER (PARTITION BY type, k) AS first FROM k WHERE k <> 'l:'),
linked AS (SELECT DISTINCT id AS a, first AS b FROM star WHERE id <> first UNION SELECT DISTINCT first, id FROM star WHERE id <> first),
reached(id, comp) AS (SELECT id, id FROM full_nodes UNION SELECT linked.b, reached.comp FROM reached JOIN linked ON reached.id = linked.a),
comps AS (SELECT id, min(comp) AS comp FROM reached GROUP BY id),
placed_ids AS (SELECT id, comp, CASE WHEN type = 'disease' THEN coalesce(nullif(list_position(['MONDO', 'ORPHA', 'OMIM', 'DOID', 'MESH'], split_part(id, ':', 1)), 0) - 1, 5) WHEN type = 'gene' THEN 4 WHEN type = 'phenotype' THEN 1 WHEN type = 'mechanism' THEN 2 ELSE 0 END AS rank FROM comps JOIN full_nodes USING (id)),
grouped AS MATERIALIZED (SELECT id, rank, first_value(id) OVER (PARTITION BY comp ORDER BY rank, id) AS head FROM placed_ids)"""

TEXTS = f"""{GROUPS},
own AS (SELECT g.head, g.rank, n.*, h.label AS head_label FROM grouped g JOIN full_nodes n ON g.id = n.id JOIN full_nodes h ON g.head = h.id),
said AS (SELECT head, 'synonym' AS kind, rank, id, head_label AS no, unnest([label] || synonyms) AS text, unnest(range(1 + len(synonyms))) AS pos FROM own UNION ALL SELECT head, 'xref', rank, id, head, unnest([id] || xrefs), unnest(range(1 + len(xrefs))) FROM own),
once AS (SELECT head, kind, text, min({{'r': rank, 'i': id, 'p': pos}}) AS spot FROM said WHERE text <> no GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY head, kind ORDER BY spot) AS place FROM once)"""

REWRITTEN = f"""{GROUPS},
moved AS (SELECT a.head AS source_id, relation, b.head AS target_id, source, record_id, confidence, evidence_type, qualifier FROM raw JOIN grouped a ON source_id = a.id JOIN grouped b ON target_id = b.id),
moved_ids AS MATERIALIZED (SELECT 'E:' || substr(sha256('["' || source_id || '","' || relation || '","' || target_id || '","' || source || '","' || record_id || '"]'), 1, 16) AS id, * FROM moved),
after AS MATERIALIZED (SELECT * FROM moved_ids WHERE source_id <> target_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, evidence_type DESC, coalesce(qualifier, '') DESC) = 1)"""

_NAME = "array_to_string(regexp_extract_all(replace(lower({0}), chr(39) || 's', ''), '[a-z0-9]+'), ' ')"
INDEX = f"""
named AS (SELECT 'N:' || n_nationkey AS id, n_name AS label, ['land ' || n_nationkey, 'Region ' || n_regionkey] AS synonyms FROM nation),
syn AS (SELECT id, {_NAME.format("s")} AS name FROM (SELECT id, unnest(synonyms) AS s FROM named)),
cand AS (SELECT {_NAME.format("label")} AS name, id, 0 AS rank FROM named UNION ALL SELECT name, id, 1 FROM syn WHERE name IN (SELECT name FROM syn GROUP BY name HAVING count(DISTINCT id) = 1) UNION ALL SELECT {_NAME.format("min(c_mktsegment)")}, 'N:0', 2 FROM customer),
ix AS MATERIALIZED (SELECT name, id AS node_id, ['label', 'synonym', 'alias'][rank + 1] AS kind, rank FROM cand QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, id) = 1),
studies AS (SELECT 'O:' || o_orderkey AS study_id, list_filter([CASE o_orderstatus WHEN 'F' THEN 'Land-' || n_nationkey WHEN 'O' THEN n_name || chr(39) || 's' END, c_mktsegment, CASE WHEN o_orderpriority = '1-URGENT' THEN 'region ' || n_regionkey END], lambda x: x IS NOT NULL) AS conditions,
  o_orderpriority = '2-HIGH' AS seeded, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
each AS (SELECT study_id, status, unnest(conditions) AS condition FROM studies),
mapped AS MATERIALIZED (SELECT study_id, status, condition, node_id, kind, rank FROM each LEFT JOIN ix ON ix.name = {_NAME.format("condition")})"""

_C = lambda x: f"CASE WHEN len({_KEY.format(x)}) > 0 THEN {_KEY.format(x)} ELSE {_WORDS.format(x)} END"
RESOLVED = f"""{FULL},
rn AS (SELECT id, label, synonyms, xrefs FROM full_nodes WHERE type <> 'study' UNION ALL SELECT DISTINCT 'V:' || vec_id // 2, 'Held V:' || vec_id // 2, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM embeddings),
rt AS (SELECT id, pos, {_PLAIN.replace("label", "text")} AS p FROM (SELECT id, unnest([label] || synonyms) AS text, unnest(range(1 + len(synonyms))) AS pos FROM rn)),
rk AS MATERIALIZED (SELECT DISTINCT 0 AS stage, p AS k, id FROM rt WHERE pos = 0 AND p <> '' UNION SELECT 1, upper(x), id FROM (SELECT id, unnest([id] || xrefs) AS x FROM rn) UNION SELECT 2, array_to_string({_C("p")}, ' '), id FROM rt WHERE p <> ''),
rm AS MATERIALIZED (SELECT DISTINCT mention, {_PLAIN.replace("label", "mention")} AS p FROM (SELECT lower(n_name) AS mention FROM nation UNION SELECT 'orpha:' || n_nationkey FROM nation UNION SELECT 'Land ' || n_nationkey FROM nation UNION SELECT p_name FROM part UNION SELECT p_brand FROM part
  UNION SELECT 'the ' || p_type || ' ' || string_split(p_name, ' ')[-1] FROM part UNION SELECT 'Unknown-' || vec_id FROM embeddings WHERE vec_id % 20 = 0)),
ra AS (SELECT mention, 0 AS stage, p AS k FROM rm UNION ALL SELECT mention, 1, CASE WHEN regexp_matches(mention, '^[A-Za-z][A-Za-z0-9_.]*:') THEN upper(mention) ELSE '' END FROM rm UNION ALL SELECT mention, 2, array_to_string({_C("p")}, ' ') FROM rm),
rh AS MATERIALIZED (SELECT ra.mention, ra.stage, ra.k, count(*) AS n, min(id) AS sole FROM ra JOIN rk ON ra.stage = rk.stage AND ra.k = rk.k GROUP BY ra.mention, ra.stage, ra.k QUALIFY row_number() OVER (PARTITION BY ra.mention ORDER BY ra.stage) = 1),
rleft AS (SELECT * FROM rm WHERE mention NOT IN (SELECT mention FROM rh)),
rq AS (SELECT 'Unknown-' || vec_id AS mention, CAST(CASE WHEN vec_id % 40 = 0 THEN list_reverse(embedding) ELSE embedding END AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
rv AS MATERIALIZED (SELECT mention, 'V:' || vec_id // 2 AS id, max(floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) * 10000 + 0.5)) / 10000 AS score FROM rq JOIN embeddings ON true WHERE mention IN (SELECT mention FROM rleft) GROUP BY ALL),
rbest AS (SELECT mention, arg_min(id, {{'s': -score, 'i': id}}) AS id, max(score) AS best, list_sort(list(score), 'DESC')[2] AS next FROM rv GROUP BY mention),
rtaken AS (SELECT * FROM rbest WHERE best >= 0.85 AND round(best - coalesce(next, 0), 4) >= 0.05),
rwords AS (SELECT mention, id, max(j) AS score FROM (SELECT l.mention, t.id, len(list_intersect({_C("l.p")}, {_C("t.p")})) / len(list_distinct({_C("l.p")} || {_C("t.p")})) AS j FROM rleft l JOIN rt t ON list_has_any({_C("l.p")}, {_C("t.p")}) WHERE l.mention NOT IN (SELECT mention FROM rv)) WHERE j >= 0.34 GROUP BY ALL),
rall AS (SELECT h.mention, rk.id, [1e0, 1e0, 0.95e0][h.stage + 1] AS score FROM rh h JOIN rk ON h.stage = rk.stage AND h.k = rk.k WHERE n > 1
  UNION ALL SELECT v.* FROM rv v JOIN rbest b USING (mention) WHERE b.best >= 0.45 AND v.mention NOT IN (SELECT mention FROM rtaken) UNION ALL SELECT * FROM rwords),
rlist AS (SELECT mention, list(id ORDER BY score DESC, id) AS ids, list(score ORDER BY score DESC, id) AS scores FROM (SELECT * FROM rall QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) <= 5) GROUP BY mention),
rkey AS (SELECT *, sha256('{{"mention":"' || mention || '","candidates":["' || array_to_string(list_sort(ids), '","') || '"]}}') AS key FROM rlist),
resolved AS MATERIALIZED (SELECT mention, sole AS node_id, ['exact', 'xref', 'synonym'][stage + 1] AS method, [1e0, 1e0, 0.95e0][stage + 1] AS score, CAST([] AS VARCHAR[]) AS ids, '' AS key FROM rh WHERE n = 1
  UNION ALL SELECT mention, id, 'embedding', best, [], '' FROM rtaken UNION ALL SELECT mention, NULL, 'none', 0e0, ids, key FROM rkey
  UNION ALL SELECT mention, NULL, 'none', 0e0, [], '' FROM rleft WHERE mention NOT IN (SELECT mention FROM rtaken) AND mention NOT IN (SELECT mention FROM rkey))"""

SQL = {
    "resolve_stages": f"{_G}, {RESOLVED} SELECT mention, node_id, method, score, array_to_string(ids, ',') AS candidates, key FROM resolved",
    "resolve_decided": f"""{_G}, {RESOLVED}, d AS (SELECT mention, CASE WHEN key <> '' AND key[1] < '8' THEN ids[-1] ELSE node_id END AS node_id, CASE WHEN key <> '' AND key[1] < '8' THEN 'llm' ELSE method END AS method FROM resolved)
        SELECT method, count(*) AS n, count(node_id) AS n_nodes, min(mention) AS first, min(node_id) AS first_node FROM d GROUP BY 1""",
    "canonical_nodes": f"""{_G}, {TEXTS},
        t AS (SELECT head, array_to_string(list(text ORDER BY place) FILTER (kind = 'synonym' AND place <= 50), '|') AS synonyms, count(*) FILTER (kind = 'synonym') AS n_synonyms, array_to_string(list(text ORDER BY place) FILTER (kind = 'xref' AND place <= 50), '|') AS xrefs, count(*) FILTER (kind = 'xref') AS n_xrefs FROM placed GROUP BY head),
        v AS (SELECT head, rank, id, unnest(map_entries(attributes)) AS e FROM own), x AS (SELECT head, e.key AS key, arg_min(e.value, {{'r': rank, 'i': id}}) AS value FROM v GROUP BY ALL), a AS (SELECT head, string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) AS attributes FROM x GROUP BY head),
        m AS (SELECT head, count(*) AS n_members FROM grouped GROUP BY head)
        SELECT n.id, n.type, n.label, n_members, coalesce(t.synonyms, '') AS synonyms, coalesce(n_synonyms, 0) AS n_synonyms, coalesce(t.xrefs, '') AS xrefs, coalesce(n_xrefs, 0) AS n_xrefs, '{{' || coalesce(a.attributes, '') || '}}' AS attributes
        FROM m JOIN full_nodes n ON m.head = n.id LEFT JOIN t ON t.head = n.id LEFT JOIN a ON a.head = n.id""",
    "canonical_aliases": f"{_G}, {GROUPS} SELECT id, head AS canonical_id FROM grouped WHERE id <> head",
    "canonical_edges": f"{_G}, {REWRITTEN} SELECT * FROM after",
    "merge_report": f"""{_G}, {REWRITTEN} SELECT (SELECT count(*) FROM full_nodes) AS n_nodes, (SELECT count(DISTINCT head) FROM grouped) AS n_canonical, (SELECT count(*) FROM moved) AS n_rows, (SELECT count(*) FROM moved WHERE source_id = target_id) AS n_loops,
        (SELECT count(*) FROM after) AS n_edges, (SELECT count(*) FROM moved WHERE source_id <> target_id) - (SELECT count(*) FROM after) AS n_merged,
        (SELECT count(DISTINCT x) FROM (SELECT unnest([source_id, target_id]) AS x FROM after) WHERE x NOT IN (SELECT head FROM grouped)) AS n_dangling""",
    "condition_index": f"WITH {INDEX} SELECT name, node_id, kind FROM ix",
    "ambiguous_synonyms": f"WITH {INDEX} SELECT name, count(DISTINCT id) AS n FROM syn GROUP BY name HAVING n > 1",
    "unmapped_conditions": f"WITH {INDEX} SELECT condition, count(*) AS n FROM mapped WHERE node_id IS NULL GROUP BY 1",
    "condition_edges": f"""WITH {INDEX}, b AS (SELECT * FROM mapped WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id, node_id ORDER BY rank, condition) = 1)
        SELECT study_id AS source_id, 'studies_condition' AS relation, node_id AS target_id, 'clinicaltrials' AS source, study_id AS record_id, CASE kind WHEN 'alias' THEN 0.65e0 ELSE 0.75e0 END AS confidence, 'observed' AS evidence_type, kind AS qualifier, condition, status FROM b""",
    "kept_studies": f"WITH {INDEX} SELECT study_id, CASE WHEN seeded THEN 'seed,wide' ELSE 'wide' END AS queries FROM studies s WHERE seeded OR EXISTS (SELECT 1 FROM mapped m WHERE m.study_id = s.study_id AND node_id IS NOT NULL)",
}
