"""The catalogue's queries as SQL over the star tables, written apart from the Spark plans to check them."""

from __future__ import annotations

from skein.operators.explain import ADVICE, HYPOTHESIS, INFERRED, PHRASES, TEMPLATE, VERSION
from skein.operators.trust import RULES

def r4(x: str) -> str:
    """Four decimals, halves of the exact binary value to the even neighbour, by the same arithmetic in doubles."""
    split = "list_transform([[v * 134217729e0 - (v * 134217729e0 - v), v * 10000e0]], lambda h: list_transform([floor(h[2])], lambda f: {0})[1])[1]"
    over = "((h[2] - f - 0.5e0) + ((h[1] * 10000e0 - h[2]) + (v - h[1]) * 10000e0))"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: " + split.format(f"(f + CASE WHEN {over} > 0 OR ({over} = 0 AND f % 2 <> 0) THEN 1e0 ELSE 0e0 END) / 10000e0") + ")[1]"


NODES = """
nodes AS (
  SELECT 'N:' || n_nationkey AS id, 'disease' AS type, n_name AS label FROM nation
  UNION ALL SELECT 'P:' || p_partkey, 'phenotype', p_name FROM part
  UNION ALL SELECT DISTINCT 'B:' || p_brand, 'gene', p_brand FROM part
  UNION ALL SELECT DISTINCT 'T:' || p_type, 'mechanism', p_type FROM part
  UNION ALL SELECT 'S:' || s_suppkey, 'investigator', s_name FROM supplier
  UNION ALL SELECT 'R:' || r_regionkey, 'funder', r_name FROM region
  UNION ALL SELECT 'O:' || o_orderkey, 'study', 'Order ' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'C:' || c_mktsegment, 'patient_group', c_mktsegment FROM customer)"""

EVIDENCE = """
lines AS (SELECT l.*, o_orderpriority, c_nationkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
returned AS (SELECT * FROM lines WHERE l_returnflag = 'R'),
ranked AS (
  SELECT c_nationkey, p_brand, row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(CAST(l_quantity AS BIGINT)) DESC, p_brand) AS r
  FROM returned JOIN part ON l_partkey = p_partkey GROUP BY c_nationkey, p_brand),
per_type AS (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS total FROM part GROUP BY p_brand, p_type),
raw AS (
  SELECT 'N:' || c_nationkey AS source_id, 'has_phenotype' AS relation, 'P:' || l_partkey AS target_id, 'monarch' AS source, 'L-' || l_orderkey || '-' || l_linenumber AS record_id,
         CAST(1 - l_discount AS DOUBLE) AS confidence, CASE WHEN l_discount < 0.02 THEN 'observed' WHEN l_discount < 0.07 THEN 'curated' ELSE 'inferred' END AS evidence_type,
         'infores:' || lower(split_part(o_orderpriority, '-', -1)) AS qualifier FROM returned
  UNION ALL SELECT 'N:' || c_nationkey, 'caused_by', 'B:' || p_brand, 'ranking', 'Q-' || c_nationkey || '-' || r, CASE r WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.8e0 ELSE 0.7e0 END, 'curated', NULL FROM ranked WHERE r <= 3
  UNION ALL SELECT 'B:' || p_brand, 'participates_in', 'T:' || p_type, 'go', 'G-' || p_brand || '-' || p_type, 0.8e0, 'curated', CASE WHEN n * 5 >= total THEN 'ECO:0000314,ECO:0000501' ELSE 'ECO:0000501' END FROM per_type WHERE 6 * n >= total
  UNION ALL SELECT 'S:' || l_suppkey, 'investigates', 'N:' || c_nationkey, 'reporter', 'I-' || l_suppkey || '-' || c_nationkey, 0.75e0, 'observed', CAST(count(*) AS VARCHAR) FROM returned GROUP BY l_suppkey, c_nationkey
  UNION ALL SELECT 'R:' || n_regionkey, 'funds', 'S:' || s_suppkey, 'curated', 'F-' || n_regionkey || '-' || s_suppkey, 0.6e0, 'curated', ['page_read', 'url_resolves', 'cited'][n_regionkey % 3 + 1] FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'R:' || n_regionkey, 'funds', 'B:' || p_brand, 'curated', 'FB-' || n_regionkey || '-' || p_brand, 0.55e0, 'curated', 'cited' FROM ranked JOIN nation ON c_nationkey = n_nationkey WHERE r = 1
  UNION ALL SELECT DISTINCT 'C:' || c_mktsegment, 'represents', 'N:' || c_nationkey, 'curated', 'C-' || c_mktsegment || '-' || c_nationkey, 0.5e0, 'curated', 'unverified' FROM customer
  UNION ALL SELECT 'O:' || o_orderkey, 'studies_condition', 'N:' || c_nationkey, 'clinicaltrials', 'O-' || o_orderkey, 0.75e0, 'observed', CASE WHEN o_orderstatus = 'F' THEN 'alias' ELSE 'label' END FROM orders JOIN customer ON o_custkey = c_custkey),
evidence AS (
  SELECT 'E:' || substr(sha256('["' || source_id || '","' || relation || '","' || target_id || '","' || source || '","' || record_id || '"]'), 1, 16) AS id, * FROM raw),
edges AS MATERIALIZED (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, evidence_type DESC, qualifier DESC) = 1),
disputes AS (
  SELECT 'N:' || a.c_nationkey AS source_id, 'has_phenotype' AS relation, 'P:' || a.l_partkey AS target_id, 'A-' || l_orderkey || '-' || l_linenumber AS record_id
  FROM lines a WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM returned r WHERE r.c_nationkey = a.c_nationkey AND r.l_partkey = a.l_partkey)),
disputed AS (SELECT source_id, relation, target_id, count(*) AS n FROM disputes GROUP BY ALL)"""

ENDS = """
ends AS (
  SELECT source_id AS node_id, target_id AS other_id, 'out' AS direction, * FROM edges
  UNION ALL SELECT target_id, source_id, 'in', * FROM edges WHERE source_id <> target_id)"""

INDEPENDENT = "CASE WHEN source = 'monarch' THEN coalesce(qualifier, 'monarch') WHEN source = 'curated' AND (record_id LIKE 'PMID:%') THEN record_id WHEN source = 'curated' AND record_id LIKE 'NCT%' THEN 'clinicaltrials' ELSE source END"

PROFILES = """
notes AS (SELECT DISTINCT source_id AS thing, target_id AS feature FROM edges WHERE relation = 'has_phenotype'),
weights AS (SELECT feature, -ln(count(*) / (SELECT count(*) FROM nodes WHERE type = 'disease')) AS ic FROM notes GROUP BY feature),
genes AS (SELECT DISTINCT source_id AS thing, target_id AS feature FROM edges WHERE relation = 'caused_by'),
profiles AS MATERIALIZED (
  SELECT thing, 'phenotype' AS kind, n.feature, CAST(floor(ic * 1000000 + 0.5) AS BIGINT) AS weight FROM notes n JOIN weights w ON n.feature = w.feature WHERE ic >= 2.5e0
  UNION ALL SELECT thing, 'gene', feature, 1 FROM genes
  UNION ALL SELECT DISTINCT thing, 'mechanism', target_id, 1 FROM genes JOIN edges ON feature = source_id AND relation = 'participates_in'),
own AS (SELECT kind, thing, sum(weight) AS own FROM profiles GROUP BY kind, thing),
shared AS (
  SELECT a.kind, a.thing AS a, b.thing AS b, count(*) AS n_shared, CAST(sum(a.weight) AS BIGINT) AS shared
  FROM profiles a JOIN profiles b ON a.kind = b.kind AND a.feature = b.feature AND a.thing < b.thing GROUP BY a.kind, a.thing, b.thing),
scored AS (
  SELECT s.kind, a, b, n_shared, shared, CAST(x.own + y.own - shared AS BIGINT) AS total, shared / (x.own + y.own - shared) AS score
  FROM shared s JOIN own x ON a = x.thing AND s.kind = x.kind JOIN own y ON b = y.thing AND s.kind = y.kind),
wide AS (
  SELECT a, b, coalesce(max(score) FILTER (kind = 'phenotype'), 0e0) AS p, coalesce(max(score) FILTER (kind = 'gene'), 0e0) AS g, coalesce(max(score) FILTER (kind = 'mechanism'), 0e0) AS m,
         coalesce(max(n_shared) FILTER (kind = 'phenotype'), 0) AS n_phenotype, coalesce(max(n_shared) FILTER (kind = 'gene'), 0) AS n_gene, coalesce(max(n_shared) FILTER (kind = 'mechanism'), 0) AS n_mechanism
  FROM scored GROUP BY a, b),
pairs AS MATERIALIZED (SELECT * FROM (SELECT a, b, {p} AS phenotype, {g} AS gene, {m} AS mechanism, n_phenotype, n_gene, n_mechanism, {total} AS score FROM wide) WHERE score > 0)""".format(
    p=r4("p"), g=r4("g"), m=r4("m"), total=r4("p * 0.5e0 + 0.3e0 * g + 0.2e0 * m")
)

BUYERS = """
WITH n AS (SELECT DISTINCT 'U:' || o_custkey AS thing, 'P:' || l_partkey AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
i AS (SELECT feature, -ln(count(*) / (SELECT count(*) FROM customer)) AS ic FROM n GROUP BY feature),
f AS MATERIALIZED (SELECT thing, feature, CAST(floor(ic * 1000000 + 0.5) AS BIGINT) AS weight FROM n JOIN i USING (feature) WHERE ic >= 2.5e0)"""

CLUSTERS = """
likes AS (SELECT a, b FROM pairs WHERE score >= 0.1 UNION SELECT b, a FROM pairs WHERE score >= 0.1),
reached(id, comp) AS (SELECT id, id FROM nodes WHERE type = 'disease' UNION SELECT likes.b, reached.comp FROM reached JOIN likes ON reached.id = likes.a),
comps AS (SELECT id, min(comp) AS label FROM reached GROUP BY id),
numbered AS (SELECT label, 'C' || row_number() OVER (ORDER BY count(*) DESC, min(id)) AS cluster FROM comps GROUP BY label),
clusters AS MATERIALIZED (SELECT id, cluster FROM comps JOIN numbered USING (label))"""

ROUTES = """
priced AS (
  SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, id,
         CAST(floor((-ln(greatest(confidence, 0.01)) + CASE WHEN evidence_type = 'inferred' THEN 1.0 ELSE 0.0 END) * 1000000 + 0.5) AS BIGINT) AS cost FROM edges WHERE source_id <> target_id),
routes AS MATERIALIZED (
  SELECT lo, hi, cost, cost + 750000 * (CAST(x.type = 'phenotype' AS BIGINT) + CAST(y.type = 'phenotype' AS BIGINT)) AS w, p.id AS edge_id
  FROM priced p JOIN nodes x ON lo = x.id JOIN nodes y ON hi = y.id QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY cost, p.id) = 1)"""

NEAR = """
s AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
one AS (SELECT DISTINCT b AS id FROM s WHERE a = 'N:3' AND b <> 'N:3'), walk AS (SELECT one.id FROM one JOIN nodes USING (id) WHERE type <> 'phenotype'),
two AS (SELECT DISTINCT s.b AS id FROM walk JOIN s ON walk.id = s.a WHERE s.b <> 'N:3' AND s.b NOT IN (SELECT id FROM one)),
near AS (SELECT n.id, type, label, distance FROM (SELECT 'N:3' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) n JOIN nodes USING (id)),
capped AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY type ORDER BY distance, label, id) <= 30),
shown AS MATERIALIZED (SELECT id, type, distance FROM capped ORDER BY distance, type, label, id LIMIT 150),
drawn AS MATERIALIZED (
  SELECT e.*, d.n IS NOT NULL AS is_contradiction FROM edges e LEFT JOIN disputed d ON e.source_id = d.source_id AND e.relation = d.relation AND e.target_id = d.target_id
  WHERE e.source_id IN (SELECT id FROM shown) AND e.target_id IN (SELECT id FROM shown) ORDER BY d.n IS NOT NULL DESC, confidence DESC, e.id LIMIT 400)"""

_G = f"WITH RECURSIVE {NODES}, {EVIDENCE}"
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_PLAIN = "trim(regexp_replace(replace(lower(label), chr(39), ''), '[^a-z0-9]+', ' ', 'g'))"
_KEY = "list_filter(string_split({0}, ' '), lambda w: w <> '' AND w NOT IN ('disease','syndrome','disorder','type','the','of','a','an','and','form'))"
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"

_TRIPLE = "source_id, relation, target_id"
_DISPUTED = "LEFT JOIN disputed d ON e.source_id = d.source_id AND e.relation = d.relation AND e.target_id = d.target_id"
_RULE = """CASE WHEN evidence_type = 'inferred' THEN 'inferred_computed' WHEN source = 'monarch' THEN CASE WHEN relation = 'has_phenotype' THEN 'kb_phenotype' ELSE 'kb_gene_disease' END
  WHEN source = 'go' THEN CASE WHEN qualifier LIKE '%ECO:0000314%' THEN 'go_experimental' ELSE 'go_iea' END WHEN source = 'clinicaltrials' THEN CASE WHEN qualifier = 'alias' THEN 'ctgov_alias' ELSE 'ctgov_record' END
  WHEN source = 'reporter' THEN 'reporter_record' WHEN source = 'curated' THEN CASE qualifier WHEN 'page_read' THEN 'org_page_read' WHEN 'url_resolves' THEN 'org_url_resolves' WHEN 'unverified' THEN 'curated_unverified' ELSE 'team_curated' END END"""
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}e0, '{label}')" for k, (v, label) in RULES.items()) + ") AS t(rule, base, says))"
_CORROBORATED = f"corroborated AS (SELECT {_TRIPLE}, count(DISTINCT {INDEPENDENT}) AS n_sources, count(*) AS n_records, array_to_string(list_sort(list(DISTINCT regexp_replace({INDEPENDENT}, '^infores:', ''))), ', ') AS sources FROM evidence GROUP BY ALL)"
_CITATION = """CASE source WHEN 'monarch' THEN 'Monarch Initiative' WHEN 'go' THEN 'Gene Ontology annotation' WHEN 'clinicaltrials' THEN 'ClinicalTrials.gov ' || record_id WHEN 'curated' THEN 'team-curated, cited source' ELSE source || ' ' || record_id END"""
_SAID = "CASE relation " + " ".join(f"WHEN '{r}' THEN '{p.split('{source}')[0]}' || a.label || '{p.split('{source}')[1].split('{target}')[0]}' || b.label || '.'" for r, p in PHRASES.items()) + " END"
_SENTENCES = f"said AS (SELECT e.*, a.label AS source_label, b.label AS target_label, {_SAID} AS plain FROM edges e JOIN nodes a ON source_id = a.id JOIN nodes b ON target_id = b.id)"
_PREFIX = f"CASE WHEN evidence_type = 'inferred' THEN '{HYPOTHESIS}' ELSE '' END"
_FULL = f"{_PREFIX} || upper(substr(plain, 1, 1)) || substr(plain, 2)"
_RESEARCHER = f"{_FULL} || ' (Source: ' || {_CITATION} || '; ' || evidence_type || ', confidence ' || printf('%.2f', confidence) || ')'"
_EXPLAINED = f"""
{_SENTENCES}, causes AS (SELECT target_id, min(id) AS id FROM edges WHERE relation = 'caused_by' GROUP BY target_id),
asked AS (SELECT t.source_id || '|' || t.target_id AS explanation_id, c.id AS first, t.id AS second FROM edges t JOIN causes c ON t.source_id = c.target_id WHERE t.relation = 'participates_in'),
told AS (
  SELECT explanation_id, CAST(2 AS INT) AS n_steps, 'This path links ' || x.source_label || ' to ' || y.target_label || ' through 2 recorded fact(s).' AS summary, x.plain || chr(10) || y.plain AS steps,
    array_to_string(list_filter(['{ADVICE}', CASE WHEN x.evidence_type = 'inferred' OR y.evidence_type = 'inferred' THEN '{INFERRED}' END,
      CASE WHEN x.confidence < 0.7 OR y.confidence < 0.7 THEN 'Lower-confidence links (below 0.7): ' || array_to_string(list_filter([CASE WHEN x.confidence < 0.7 THEN x.id END, CASE WHEN y.confidence < 0.7 THEN y.id END], lambda i: i IS NOT NULL), ', ') || '.' END, '{TEMPLATE}'], lambda i: i IS NOT NULL), chr(10)) AS caveats,
    sha256('{VERSION}' || chr(10) || 'family' || chr(10) || x.id || ',' || y.id) AS key
  FROM asked JOIN said x ON first = x.id JOIN said y ON second = y.id)"""
_EDGE = f"id, {_TRIPLE}, source, record_id, confidence, evidence_type, qualifier"
_BY = "'E:' || substr(sha256('[\"record:' || record_id || '\",\"contradicts\",\"' || target_id || '\",\"registry\",\"' || record_id || '\"]'), 1, 16)"

#: Any three ways over one node bound what the third cheapest path costs, so what costs more is no path to go on with.
_PATHS = """
s AS (SELECT lo AS a, hi AS b, w, cost, edge_id FROM routes UNION ALL SELECT hi, lo, w, cost, edge_id FROM routes),
u AS (SELECT max(w) AS most FROM (SELECT x.w + y.w AS w FROM s x JOIN s y ON x.b = y.a WHERE x.a = 'N:0' AND y.b = 'N:7' ORDER BY 1 LIMIT 3)),
p(path, ids, here, w, cost) AS (
  SELECT ['N:0'], CAST([] AS VARCHAR[]), 'N:0', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT list_append(path, s.b), list_append(ids, s.edge_id), s.b, p.w + s.w, p.cost + s.cost FROM p JOIN s ON p.here = s.a, u
  WHERE p.here <> 'N:7' AND len(path) <= 8 AND NOT list_contains(path, s.b) AND p.w + s.w <= most),
best AS (SELECT array_to_string(path, '>') AS path, ids, w, cost FROM p WHERE here = 'N:7' ORDER BY w, 1 LIMIT 3)"""

SQL = {
    "k_paths": f"{_G}, {ROUTES}, {_PATHS} SELECT path, array_to_string(ids, ',') AS edge_ids, w, round(cost / 1000000, 4) AS cost, CAST(len(ids) AS INT) AS n_edges FROM best",
    "path_hydration": f"""{_G}, {ROUTES}, {_PATHS}, h AS (SELECT path AS path_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM best)
        SELECT path_id, string_agg(h.id, ',' ORDER BY i) AS edge_ids, min(confidence) AS least_confidence, bool_or(evidence_type = 'inferred') AS has_inferred, bool_or(d.n IS NOT NULL) AS has_contradiction, count(*) AS n_hops
        FROM h JOIN edges e ON e.id = h.id {_DISPUTED} GROUP BY path_id""",
    "graph_edges": f"{_G} SELECT {_EDGE} FROM evidence",
    "edge_dedup": f"{_G} SELECT {_EDGE} FROM edges",
    "independent_sources": f"{_G} SELECT id, {INDEPENDENT} AS independent_source FROM evidence",
    "corroboration": f"{_G}, {_CORROBORATED} SELECT * FROM corroborated",
    "rubric_score": f"""{_G}, {_RULES}, {_CORROBORATED},
        j AS (SELECT e.id, e.{_TRIPLE.replace(", ", ", e.")}, evidence_type, confidence, source, qualifier, {_RULE.replace("relation", "e.relation")} AS rule, n_sources, sources, coalesce(d.n, 0) AS n_disputes
          FROM evidence e JOIN corroborated USING ({_TRIPLE}) {_DISPUTED}),
        k AS (SELECT j.*, says, coalesce(base, confidence) AS base, CASE WHEN n_sources >= 2 THEN least(0.05e0 * (n_sources - 1), 0.15e0) ELSE 0e0 END AS bonus FROM j LEFT JOIN rules USING (rule)),
        v AS (SELECT *, base + bonus - 0.15e0 * n_disputes AS value FROM k)
        SELECT id, {_TRIPLE}, evidence_type, confidence, rule, n_sources, n_disputes,
          {r4("least(greatest(value, 0.05e0), CASE WHEN evidence_type = 'inferred' THEN 0.49e0 ELSE 0.99e0 END)")} AS score,
          array_to_string(list_filter([CASE WHEN rule = 'inferred_computed' THEN 'computed analytics value ' || printf('%.2f', confidence) WHEN says IS NULL THEN 'no rubric row for ' || source || '; ingest value'
              ELSE says || CASE WHEN source = 'monarch' THEN ' (' || replace(qualifier, 'infores:', '') || ' via Monarch)' ELSE '' END || ' ' || printf('%.2f', base) END,
            CASE WHEN n_sources >= 2 THEN '+' || printf('%.2f', bonus) || ' corroborated by ' || n_sources || ' sources (' || sources || ')' END,
            CASE WHEN n_disputes > 0 THEN '-' || printf('%.2f', 0.15e0 * n_disputes) || ' contradicted by ' || n_disputes || CASE WHEN n_disputes = 1 THEN ' record' ELSE ' records' END END,
            CASE WHEN evidence_type = 'inferred' AND value > 0.49 THEN 'capped at 0.49: inferred stays below curated' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM v""",
    "contradictions": f"{_G} SELECT {_TRIPLE}, record_id FROM disputes",
    "contradiction_edges": f"{_G} SELECT DISTINCT {_BY} AS id, 'record:' || record_id AS source_id, 'contradicts' AS relation, target_id, record_id FROM disputes",
    "contradicted_by": f"""{_G}, b AS (SELECT DISTINCT {_TRIPLE}, {_BY} AS by_id FROM disputes), l AS (SELECT {_TRIPLE}, count(*) AS n, array_to_string(list_sort(list(by_id))[:5], ',') AS contradicted_by FROM b GROUP BY ALL)
        SELECT id, n, contradicted_by FROM evidence JOIN l USING ({_TRIPLE})""",
    "integrity_violations": f"""{_G}, known AS (SELECT * FROM nodes WHERE label NOT LIKE '%7%')
        SELECT 'dangling_end' AS rule, id AS subject FROM (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges) x WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = x.id)""",
    "missing_support": f"""{_G}, p AS (SELECT id, record_id, regexp_extract(record_id, '^(L-[0-9]+-)', 1) || (CAST(regexp_extract(record_id, '([0-9]+)$', 1) AS INT) - 1) AS supporting_id FROM evidence WHERE relation = 'has_phenotype')
        SELECT id, supporting_id FROM p WHERE supporting_id NOT IN (SELECT record_id FROM p)""",
    "error_report": f"""{_G}, known AS (SELECT * FROM nodes WHERE label NOT LIKE '%7%'), x AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges), v AS (SELECT 'dangling_end: ' || id AS line FROM x WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = x.id))
        SELECT count(*) AS n, array_to_string(list_sort(list(line))[:10], '; ') || CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ' more)' ELSE '' END AS report FROM v""",
    "edge_detail": f"""{_G} SELECT e.id, a.label AS source_label, a.type AS source_type, b.label AS target_label, b.type AS target_type, e.relation, e.confidence, coalesce(d.n, 0) AS n_disputes
        FROM edges e JOIN nodes a ON e.source_id = a.id JOIN nodes b ON e.target_id = b.id {_DISPUTED}""",
    "disease_profiles": f"{_G}, {PROFILES} SELECT thing, kind, feature, weight FROM profiles",
    "buyer_similarity": f"""{BUYERS}, own AS (SELECT thing, sum(weight) AS own FROM f GROUP BY thing),
        s AS (SELECT a.thing AS a, b.thing AS b, count(*) AS n_shared, CAST(sum(a.weight) AS BIGINT) AS shared FROM f a JOIN f b ON a.feature = b.feature AND a.thing < b.thing GROUP BY 1, 2)
        SELECT a, b, n_shared, shared, CAST(x.own + y.own - shared AS BIGINT) AS total, {r4("shared / (x.own + y.own - shared)")} AS score FROM s JOIN own x ON a = x.thing JOIN own y ON b = y.thing""",
    "weighted_jaccard": f"{_G}, {PROFILES} SELECT kind, a, b, n_shared, shared, total, {r4('score')} AS score FROM scored",
    "pair_scores": f"{_G}, {PROFILES} SELECT a, b, phenotype, gene, mechanism, n_phenotype, n_gene, n_mechanism, score FROM pairs",
    "shared_phenotypes": f"""{BUYERS} SELECT x.thing AS a, y.thing AS b, row_number() OVER (PARTITION BY x.thing, y.thing ORDER BY x.weight DESC, x.feature) AS rank, x.feature
        FROM f x JOIN f y ON x.feature = y.feature AND x.thing < y.thing QUALIFY rank <= 5""",
    "shared_features": f"""{_G}, x AS (SELECT DISTINCT n_regionkey AS cluster, target_id AS item, source_id AS member FROM edges JOIN nation ON source_id = 'N:' || n_nationkey WHERE relation = 'has_phenotype')
        SELECT cluster, item, array_to_string(list_sort(list(DISTINCT member)), ',') AS members, count(DISTINCT member) AS n FROM x GROUP BY cluster, item HAVING count(DISTINCT member) >= 2""",
    "similarity_components": f"""{_G}, {PROFILES}, e AS (SELECT a, b FROM pairs WHERE score >= 0.1 UNION SELECT b, a FROM pairs WHERE score >= 0.1),
        r(id, comp) AS (SELECT a, a FROM e UNION SELECT e.b, r.comp FROM r JOIN e ON r.id = e.a) SELECT id, min(comp) AS comp FROM r GROUP BY id""",
    "routing_graph": f"{_G}, {ROUTES} SELECT lo, hi, cost, w, edge_id FROM routes",
    "evidence_map": f"{_G}, {NEAR} SELECT id, type, distance FROM shown",
    "map_edges": f"{_G}, {NEAR} SELECT id, is_contradiction, CASE WHEN is_contradiction THEN 'contradiction' WHEN evidence_type = 'inferred' THEN 'hypothesis' ELSE 'data' END AS edge_class FROM drawn",
    "map_legend": f"""{_G}, {NEAR}, {ENDS} SELECT 'node' AS kind, type AS name, count(*) AS n FROM shown GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM drawn GROUP BY 2 UNION ALL SELECT 'evidence', evidence_type, count(*) FROM drawn GROUP BY 2
        UNION ALL SELECT 'hidden', type, count(*) FROM near WHERE id NOT IN (SELECT id FROM shown) GROUP BY 2
        UNION ALL SELECT 'hidden edges', 'edges', count(DISTINCT id) FROM ends WHERE node_id IN (SELECT id FROM shown) AND id NOT IN (SELECT id FROM drawn)""",
    "map_overview": f"""{_G}, {ENDS}, o AS (SELECT id FROM nodes WHERE type IN ('disease', 'gene', 'mechanism', 'patient_group', 'asset', 'publication', 'variant'))
        SELECT id, type, id IN (SELECT id FROM o) OR (type = 'funder' AND id IN (SELECT node_id FROM ends WHERE other_id IN (SELECT id FROM o))) AS shown FROM nodes""",
    "map_pulled_in": f"""{_G}, {NEAR}, x AS (SELECT DISTINCT disputes.record_id FROM disputes JOIN edges e USING ({_TRIPLE}) WHERE e.source_id IN (SELECT id FROM shown) AND e.target_id IN (SELECT id FROM shown))
        SELECT 'record:' || record_id AS id, 'publication' AS type FROM x""",
    "template_sentences": f"{_G}, {_SENTENCES} SELECT id, {_FULL} AS sentence FROM said",
    "researcher_sentences": f"{_G}, {_SENTENCES} SELECT id, {_RESEARCHER} AS sentence FROM said",
    "source_citations": f"{_G} SELECT id, {_CITATION} AS citation FROM edges",
    "edge_content_hashes": f"{_G} SELECT id, sha256(id || chr(10) || source_id || chr(10) || relation || chr(10) || target_id || chr(10) || evidence_type || chr(10) || printf('%.4f', confidence)) AS hash FROM edges",
    "explanations": f"{_G}, {_EXPLAINED} SELECT * FROM told",
    "explanation_cache": f"{_G}, {_EXPLAINED} SELECT explanation_id, CASE WHEN key[1] < '8' THEN 'kept: ' || summary ELSE summary END AS text, CASE WHEN key[1] < '8' THEN 'cache' ELSE 'template' END AS origin FROM told",
    "caveats": f"""{_G}, m AS (SELECT e.*, d.n IS NOT NULL AS disputed FROM edges e {_DISPUTED}),
        c AS (SELECT relation, count(*) FILTER (evidence_type = 'inferred') AS n_inferred, count(*) FILTER (confidence < 0.7) AS n_low, count(*) FILTER (disputed) AS n_disputed FROM m GROUP BY relation)
        SELECT *, array_to_string(list_filter([CASE WHEN n_inferred > 0 THEN n_inferred || ' inferred' END, CASE WHEN n_low > 0 THEN n_low || ' of low confidence' END, CASE WHEN n_disputed > 0 THEN n_disputed || ' disputed' END], lambda x: x IS NOT NULL), '; ') AS caveats FROM c""",
    "explanation_checks": f"""{_G}, {_SENTENCES}, t AS (SELECT id, regexp_extract_all({_RESEARCHER}, '([0-9]+\\.[0-9]+|[0-9]{{2,}})', 1) AS numbers, source_label || ' ' || target_label || ' ' || record_id AS context FROM said)
        SELECT id, CASE WHEN len(list_filter(numbers, lambda n: NOT contains(context, n))) > 0 THEN 'unseen number' END AS problem FROM t""",
    "related_tiers": f"""{_G}, t AS (SELECT source_id AS disease, target_id AS item, 1 AS tier FROM edges WHERE relation = 'caused_by'
          UNION SELECT c.source_id, p.target_id, 2 FROM edges c JOIN edges p ON c.target_id = p.source_id WHERE c.relation = 'caused_by' AND p.relation = 'participates_in'),
        m AS (SELECT x.disease AS a, y.disease AS b, x.tier, x.item FROM t x JOIN t y ON x.item = y.item AND x.tier = y.tier AND x.disease < y.disease)
        SELECT a, b, tier, count(DISTINCT item) AS n_shared FROM m GROUP BY a, b, tier QUALIFY tier = min(tier) OVER (PARTITION BY a, b)""",
    "merge_duplicates": f"""{_G}, n AS (SELECT id, type, {_PLAIN} AS k FROM nodes WHERE type IN ('phenotype', 'gene', 'disease')),
        k AS (SELECT id, type, array_to_string(CASE WHEN len({_KEY.format("k")}) > 0 THEN {_KEY.format("k")} ELSE {_WORDS.format("k")} END, ' ') AS k FROM n WHERE k <> '' UNION ALL SELECT 'P:' || p_partkey, 'phenotype', 'x:' || p_brand || ':' || p_size FROM part),
        e AS (SELECT DISTINCT k.id AS a, f.id AS b FROM k JOIN (SELECT type, k, min(id) AS id FROM k GROUP BY ALL) f USING (type, k)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(id, head) AS (SELECT id, id FROM n UNION SELECT u.b, r.head FROM r JOIN u ON r.id = u.a) SELECT id, min(head) AS head FROM r GROUP BY id""",
    "graph_nodes": f"{_G} SELECT id, type, label FROM nodes",
    "node_merge": f"""{_G}, r AS (SELECT id, type, label, 0 AS rank FROM nodes UNION ALL SELECT 'P:' || p_partkey, 'asset', p_brand || ' ' || p_type, 1 FROM part)
        SELECT id, arg_min(type, rank) AS type, arg_min(label, rank) AS label, array_to_string(list_filter(list_sort(list_distinct(list(label))), lambda x: x <> arg_min(label, rank)), '|') AS synonyms FROM r GROUP BY id""",
    "neighbors_filtered": f"""{_G}, {ENDS} SELECT node_id, other_id, direction, e.id, relation, confidence, evidence_type, n.type AS other_type, n.label AS other_label FROM ends e JOIN nodes n ON other_id = n.id
        WHERE confidence >= 0.95 AND relation IN ('has_phenotype', 'investigates', 'funds') AND n.type IN ('phenotype', 'investigator', 'disease')""",
    "counts_by_relation": f"{_G} SELECT relation, evidence_type, count(*) AS n_edges FROM evidence GROUP BY GROUPING SETS ((relation, evidence_type), (relation), (evidence_type), ())",
    "top_edges_per_node": f"{_G}, {ENDS} SELECT node_id, other_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CAST(relation = 'has_phenotype' AS INT), confidence DESC, id) AS rank FROM ends) WHERE rank <= 25",
    "information_content": f"""{_G}, up AS (SELECT 'P:' || p_partkey AS child, 'B:' || p_brand AS parent FROM part UNION SELECT 'B:' || p_brand, 'T:' || p_type FROM part),
        anc(id, ancestor) AS (SELECT child, child FROM up UNION SELECT parent, parent FROM up UNION SELECT anc.id, up.parent FROM anc JOIN up ON anc.ancestor = up.child),
        n AS (SELECT ancestor AS term, count(DISTINCT source_id) AS n FROM edges JOIN anc ON target_id = anc.id WHERE relation = 'has_phenotype' GROUP BY 1)
        SELECT term, n, floor(-ln(n / (SELECT count(DISTINCT source_id) FROM edges WHERE relation = 'has_phenotype')) * 10000 + 0.5) / 10000 AS ic FROM n""",
    "ontology_closure": """WITH RECURSIVE up AS (SELECT 'P:' || p_partkey AS child, 'B:' || p_brand AS parent FROM part UNION SELECT 'B:' || p_brand, 'T:' || p_type FROM part),
        anc(id, ancestor) AS (SELECT child, child FROM up UNION SELECT parent, parent FROM up UNION SELECT anc.id, up.parent FROM anc JOIN up ON anc.ancestor = up.child) SELECT id, ancestor FROM anc""",
    "bfs_depth2": f"""{_G}, s AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
        one AS (SELECT DISTINCT b AS id FROM s WHERE a = 'N:3' AND b <> 'N:3'),
        two AS (SELECT DISTINCT s.b AS id FROM one JOIN s ON one.id = s.a WHERE s.b <> 'N:3' AND s.b NOT IN (SELECT id FROM one))
        SELECT 'N:3' AS start_id, 'N:3' AS id, 0 AS distance UNION ALL SELECT 'N:3', id, 1 FROM one UNION ALL SELECT 'N:3', id, 2 FROM two""",
    "shared_investigators": f"""{_G} SELECT e.source_id AS investigator, count(DISTINCT n_regionkey) AS n_regions, count(DISTINCT target_id) AS n_diseases
        FROM edges e JOIN nation ON target_id = 'N:' || n_nationkey WHERE relation = 'investigates' GROUP BY 1 HAVING count(DISTINCT n_regionkey) >= 2""",
    "coverage_report": f"""{_G}, {ENDS}, c AS (SELECT node_id AS id, count(*) FILTER (relation = 'has_phenotype') AS phenotypes, count(*) FILTER (relation = 'caused_by') AS causes, count(*) FILTER (relation = 'investigates') AS studies,
            count(*) FILTER (evidence_type <> 'inferred' AND confidence >= 0.4) AS n_strong FROM ends GROUP BY 1),
        d AS (SELECT n.id, label, coalesce(phenotypes, 0) AS phenotypes, coalesce(causes, 0) AS causes, coalesce(studies, 0) AS studies, coalesce(n_strong, 0) AS n_strong FROM nodes n LEFT JOIN c ON n.id = c.id WHERE type = 'disease')
        SELECT id, label, phenotypes, causes, studies, n_strong, array_to_string(list_filter([CASE WHEN phenotypes = 0 THEN 'phenotypes' END, CASE WHEN causes = 0 THEN 'causes' END, CASE WHEN studies = 0 THEN 'studies' END], lambda x: x IS NOT NULL), ',') AS missing,
          CASE WHEN phenotypes = 0 AND causes = 0 AND studies = 0 THEN 'gap' WHEN phenotypes > 0 AND causes > 0 AND studies > 0 AND n_strong > 0 THEN 'supported' ELSE 'weak' END AS status FROM d""",
    "source_counts": f"{_G}, k AS (SELECT unnest(['ranking', 'catalogue', 'registry', 'urgent', 'journal']) AS source) SELECT coalesce(k.source, c.source) AS source, coalesce(n, 0) AS n FROM k FULL JOIN (SELECT source, count(*) AS n FROM evidence GROUP BY 1) c ON k.source = c.source",
    "partners": f"""{_G} SELECT i.target_id AS disease, f.source_id AS partner, max(least(i.confidence, f.confidence)) AS confidence, count(DISTINCT i.source_id) AS n_via
        FROM edges i JOIN edges f ON i.source_id = f.target_id WHERE i.relation = 'investigates' AND f.relation = 'funds' GROUP BY 1, 2""",
    "search_lexical": f"""{_G}, k AS (SELECT id, label, {_PLAIN} AS key FROM nodes),
        t AS (SELECT *, {_WORDS.format("key")} AS words, {_KEY.format("key")} AS content, ['large', 'widget'] AS asked FROM k),
        s AS (SELECT id, label, len(list_intersect(list_distinct(words), asked)) / len(list_distinct(list_concat(words, asked))) AS j, key, content, words FROM t),
        m AS (SELECT id, label, CASE WHEN key = 'large widget' THEN 1.0e0 WHEN array_to_string(CASE WHEN len(content) > 0 THEN content ELSE words END, ' ') = 'large widget' THEN 0.95e0 WHEN starts_with(key, 'large widget') THEN 0.8e0
             WHEN contains(' ' || key || ' ', ' large widget ') THEN 0.75e0 WHEN j >= 0.5 THEN 0.4e0 + 0.3e0 * j END AS score FROM s)
        SELECT id, label, floor(score * 10000 + 0.5) / 10000 AS score FROM m WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 50""",
    "resolve_names": f"""{_G}, k AS (SELECT id, {_KEY.format(_PLAIN)} AS content, {_WORDS.format(_PLAIN)} AS words FROM nodes), kk AS (SELECT id, array_to_string(CASE WHEN len(content) > 0 THEN content ELSE words END, ' ') AS key FROM k),
        g AS (SELECT key, count(DISTINCT id) AS n, min(id) AS node_id FROM kk GROUP BY key),
        m AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT n_name FROM nation), mk AS (SELECT label, {_KEY.format(_PLAIN)} AS content, {_WORDS.format(_PLAIN)} AS words FROM m)
        SELECT label AS mention, CASE WHEN n = 1 THEN node_id END AS node_id, coalesce(n, 0) AS n FROM mk LEFT JOIN g ON array_to_string(CASE WHEN len(content) > 0 THEN content ELSE words END, ' ') = g.key""",
    "resolve_embedding": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
        s AS (SELECT query_id, vec_id, floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) * 10000 + 0.5) / 10000 AS score FROM q JOIN embeddings ON vec_id <> query_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, vec_id, score, rank, floor(coalesce(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), score) * 10000 + 0.5) / 10000 AS margin FROM r QUALIFY rank <= 5""",
    "quote_verification": f"SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_CLEAN} AS t FROM documents) d JOIN (SELECT item_id, {_CLEAN} AS q FROM benchmark) b ON contains(t, q) WHERE q <> ''",
    "extraction_eval": """WITH p AS (SELECT DISTINCT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE n_chars >= 200 AND NOT contains(text, '***')), g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        c AS (SELECT (SELECT count(*) FROM p SEMI JOIN g USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g) AS n_gold)
        SELECT tp, n_predicted, n_gold, tp / n_predicted AS precision, tp / n_gold AS recall, 2 * (tp / n_predicted) * (tp / n_gold) / (tp / n_predicted + tp / n_gold) AS f1 FROM c""",
    "extraction_report": "SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (quality), (toxic), ())",
    "number_faithfulness": r"SELECT d.doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([0-9]+\.[0-9]+|[0-9]{2,})', 1))), ',') AS numbers FROM documents d WHERE regexp_matches(text, '[0-9]+\.[0-9]+|[0-9]{2,}')",
    "next_experiment": """SELECT 'N:' || c_nationkey AS disease, 'O:' || o_orderkey AS study, o_orderstatus = 'O' AS is_open, o_totalprice AS size FROM orders JOIN customer ON o_custkey = c_custkey
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderstatus = 'O' DESC, o_totalprice DESC, 'O:' || o_orderkey) = 1""",
    "predicate_upgrade": "SELECT o_orderkey, EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderstatus = o.o_orderstatus AND c.o_orderpriority = '1-URGENT') AS upgraded FROM orders o",
    "usage_rollup": "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_chats, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY role",
    "latest_per_key": "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey",
    "distinct_codes": "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS codes, count(*) AS n FROM lineitem GROUP BY l_partkey",
    "events_windows": "SELECT time_bucket(INTERVAL '60 minutes', ts) AS started, event_type, count(*) AS n_events, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '180 minutes' THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS began, count(*) AS n_events FROM s GROUP BY user_id, n""",
    "page_fields": """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""",
    "clean_text": rf"""SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE CASE WHEN contains(substr(t, 1, 120), ' ') THEN regexp_replace(substr(t, 1, 120), ' [^ ]*$', '') ELSE substr(t, 1, 120) END || '...' END AS clipped
        FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)""",
    "manifest_counts": f"{_G} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'evidence', evidence_type, count(*) FROM edges GROUP BY 2",
    "coverage_seeds": f"{_G} SELECT n.id FROM nodes n WHERE type = 'phenotype' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)",
}
