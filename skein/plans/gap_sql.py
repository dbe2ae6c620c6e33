"""The queries of gaps, caches, curated entries and studies as SQL, written apart from the Spark plans."""

from __future__ import annotations

from skein.operators import gaps
from skein.operators.caches import DECISION_PROMPT
from skein.plans.star_sql import _G

_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_printf = lambda text, *values: f"printf({_quoted(text)}, {', '.join(values or ('label',))})"
_SKIPPED = "|".join(gaps.NOT_SEARCHED)

REPORTED = f"""
per AS (SELECT 'N:' || c_nationkey AS id, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
unstudied AS (SELECT id FROM per WHERE open < done),
fewest AS (SELECT id FROM per ORDER BY n, id LIMIT 1),
untermed AS (SELECT 'B:' || p_brand AS id FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand HAVING 6 * max(n) < sum(n)),
incident AS MATERIALIZED (SELECT x.*, d.id IS NOT NULL AS here, CASE WHEN d.id IS NULL THEN NULL WHEN o.type IN ('study', 'asset') THEN 'study' WHEN o.type IN ('patient_group', 'funder') THEN 'partner' ELSE o.type END AS role,
    evidence_type <> 'inferred' AND confidence >= 0.4e0 AS strong FROM (
    SELECT source_id AS nid, target_id AS other, id AS edge_id, relation, source, confidence, evidence_type FROM edges
    UNION ALL SELECT target_id, source_id, id, relation, source, confidence, evidence_type FROM edges WHERE source_id <> target_id) x
  LEFT JOIN (SELECT id FROM nodes WHERE type = 'disease') d ON d.id = nid LEFT JOIN nodes o ON o.id = other),
counted AS (SELECT nid, count(*) AS n_edges, count(*) FILTER (strong) AS n_strong, count(*) FILTER (role = 'study') AS studies, count(*) FILTER (role = 'partner') AS partners, count(*) FILTER (role = 'gene') AS genes,
    count(*) FILTER (role IN ('study', 'partner')) AS routes, count(*) FILTER (role IN ('study', 'partner') AND strong) AS strong_routes, count(*) FILTER (relation = 'investigates') AS projects FROM incident GROUP BY nid),
named AS (SELECT nid, string_agg(label, ', ' ORDER BY other) AS genes FROM (SELECT DISTINCT nid, other FROM incident WHERE role = 'gene') JOIN nodes ON nodes.id = other GROUP BY nid),
b AS (SELECT n.*, coalesce(n_edges, 0) AS n_edges, coalesce(n_strong, 0) AS n_strong, coalesce(studies, 0) AS studies, coalesce(partners, 0) AS partners, coalesce(c.genes, 0) AS n_genes, coalesce(routes, 0) AS routes,
    coalesce(strong_routes, 0) AS strong_routes, coalesce(projects, 0) AS projects, g.genes, r_name, n.type = 'disease' AS dis, n.id IN (FROM unstudied) AS un, n.id IN (FROM untermed) AS ut, n.id IN (FROM fewest) AS gap
  FROM nodes n LEFT JOIN counted c ON c.nid = n.id LEFT JOIN named g ON g.nid = n.id LEFT JOIN (SELECT 'N:' || n_nationkey AS id, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) r ON r.id = n.id),
reported AS MATERIALIZED (SELECT id, type, CASE WHEN dis THEN CASE WHEN strong_routes > 0 AND NOT gap THEN 'supported' WHEN routes > 0 THEN 'weak_routes_only' ELSE 'no_supported_route' END
      WHEN n_strong > 0 THEN 'supported' WHEN n_edges > 0 THEN 'weak_routes_only' ELSE 'no_supported_route' END AS result,
    concat_ws('|', CASE WHEN dis AND (studies = 0 OR un) THEN {_printf(gaps.NO_STUDY)} END, CASE WHEN dis AND partners = 0 THEN {_printf(gaps.NO_PARTNER + gaps.SEARCHED, "label", "r_name")} END,
      CASE WHEN dis AND projects = 0 THEN {_printf(gaps.NO_PROJECT)} END, CASE WHEN dis AND n_genes = 0 THEN {_printf(gaps.NO_GENE)} END,
      CASE WHEN NOT dis AND ut THEN {_printf(gaps.NO_TERM)} END, CASE WHEN NOT dis AND n_edges = 0 THEN {_printf(gaps.UNMAPPED)} END) AS missing,
    concat_ws('|', CASE WHEN dis AND (studies = 0 OR un) AND genes IS NOT NULL THEN {_printf(gaps.ASK_STUDY, "genes", "label")} END, CASE WHEN dis AND partners = 0 THEN {_printf(gaps.ASK_PARTNER + gaps.CLOSEST, "label", "lower(r_name)")} END,
      CASE WHEN dis AND n_genes = 0 THEN {_printf(gaps.ASK_GENE)} END, CASE WHEN NOT dis AND ut THEN {_printf(gaps.ASK_TERM)} END, CASE WHEN NOT dis AND n_edges = 0 THEN {_printf(gaps.ASK_SOURCE)} END) AS questions,
    {_quoted(_SKIPPED)} || CASE WHEN r_name IS NULL THEN '' ELSE '|registry of ' || r_name END AS not_searched, n_edges, CASE WHEN dis THEN routes ELSE n_edges END AS n_some FROM b)"""
_R = f"{_G}, {REPORTED}"

CURATED = """
a AS (SELECT 'a' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 10 = 2 THEN 'publication' ELSE 'registry' END AS kind, CASE WHEN p_partkey % 13 = 0 THEN 'ftp' ELSE 'https' END || '://example.org/' || p_partkey AS url, p_partkey AS k, p_size,
    CASE p_partkey % 5 WHEN 1 THEN 'NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') WHEN 2 THEN 'PMID:' || p_partkey END AS record,
    CASE WHEN p_partkey % 13 = 0 THEN 'url isn''t http(s)' WHEN p_partkey % 19 = 3 THEN 'bad date' END AS problem FROM part),
g AS (SELECT *, CASE WHEN record LIKE 'NCT%' THEN 'clinicaltrials:' || record WHEN record IS NOT NULL AND kind = 'publication' THEN record ELSE 'asset:' || id END AS node_id,
    CASE WHEN record LIKE 'NCT%' THEN 'study' WHEN record IS NOT NULL AND kind = 'publication' THEN 'publication' ELSE 'asset' END AS type FROM a WHERE problem IS NULL),
o AS (SELECT 'o' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'research_charity' ELSE 'patient_association' END AS kind, CASE WHEN s_suppkey % 17 = 0 THEN 'ftp' ELSE 'https' END || '://example.org/' || s_suppkey AS url,
    s_suppkey % 2 = 0 AS page, 'N:' || s_nationkey AS disease, 'a' || s_suppkey % 29 AS slug,
    CASE WHEN s_suppkey % 17 = 0 THEN 'url isn''t http(s)' WHEN s_suppkey % 11 = 5 THEN 'needs a name' WHEN s_suppkey % 7 = 0 THEN 'unknown asset' END AS problem FROM supplier),
h AS (SELECT * FROM o WHERE problem IS NULL)"""

SQL = {
    "decision_cache": f"""WITH k AS (SELECT 'B:' || p_brand AS b, p_size, sha256('["model-1", "{DECISION_PROMPT}", "' || p_name || ' \\u2013 ' || p_partkey || '", ["B:' || p_brand || '", "T:' || p_type || '"]]') AS key FROM part WHERE p_size % 17 <> 0)
        SELECT key, b AS node_id, CASE WHEN p_size >= 25 THEN 'again' ELSE 'first' END AS rationale, CASE WHEN p_size >= 25 THEN '2025-03-01' ELSE '2025-02-01' END AS made FROM k""",
    "curated_rejects": f"WITH {CURATED} SELECT 'assets' AS section, id, problem FROM a WHERE problem IS NOT NULL UNION ALL SELECT 'organizations', id, problem FROM o WHERE problem IS NOT NULL",
    "curated_nodes": f"""WITH {CURATED} SELECT node_id AS id, type, name AS label, 'asset_slug=' || id || '|asset_type=' || kind || '|curated_retrieved=2024-03-05|curated_size=' || p_size || '|url=' || url AS attributes FROM g
        UNION ALL SELECT 'org:' || id, CASE WHEN kind = 'research_charity' THEN 'funder' ELSE 'patient_group' END, name, 'curated_retrieved=2024-04-06|org_type=' || kind || '|url=' || url || CASE WHEN page THEN '|verified=home page read in full' ELSE '' END FROM h""",
    "curated_edges": f"""WITH {CURATED}, e AS (SELECT node_id AS source_id, CASE type WHEN 'publication' THEN 'mentions' ELSE 'studies_condition' END AS relation, 'N:' || k % 25 AS target_id, coalesce(record, id) AS record_id, 0.8e0 AS confidence, 'cited' AS qualifier FROM g
          UNION ALL SELECT 'org:' || id, 'represents', disease, id, CASE WHEN page THEN 0.6e0 ELSE 0.5e0 END, CASE WHEN page THEN 'page_read' ELSE 'url_resolves' END FROM h
          UNION ALL SELECT 'org:' || h.id, 'funds', g.node_id, h.id || '|funds|' || slug, 0.8e0, 'cited' FROM h JOIN g ON g.id = slug)
        SELECT 'E:' || substr(sha256('["' || source_id || '","' || relation || '","' || target_id || '","curated","' || record_id || '"]'), 1, 16) AS id, source_id, relation, target_id, 'curated' AS source, record_id, confidence, 'curated' AS evidence_type, qualifier FROM e""",
    "study_nodes": """WITH s AS (SELECT *, 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS nct, o_orderkey % 6 <> 5 AS designed, o_orderkey % 4 <> 3 AS treated, o_orderpriority[1] AS level FROM orders)
        SELECT 'clinicaltrials:' || nct AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey ELSE nct END AS label, CASE WHEN level = '1' THEN 'URG|' ELSE '' END || nct AS synonyms,
        concat_ws('|', CASE WHEN level = '1' THEN 'acronym=URG' END, 'conditions=c1; c' || o_orderkey % 5, 'description=a b', CASE WHEN designed THEN 'enrollment=' || CAST(floor(o_totalprice) AS BIGINT) END, CASE WHEN designed THEN 'enrollment_type=ESTIMATED' END,
          'has_results=' || (o_orderstatus = 'F'), CASE WHEN treated THEN 'intervention_types=BEHAVIORAL; DEVICE; DRUG' END, CASE WHEN treated THEN 'interventions=drug ' || o_orderkey % 7 || '; care; more' END, 'nct_id=' || nct,
          CASE WHEN designed AND level <> '5' THEN 'phase=' || CASE level WHEN '2' THEN '1/2' ELSE level END END, 'start_date=' || strftime(o_orderdate, '%Y-%m'), 'status=' || o_orderstatus, 'url=https://clinicaltrials.gov/study/' || nct) AS attributes FROM s""",
    "gap_report": f"""{_R} SELECT id, type, result, CASE result WHEN 'supported' THEN 'supported' WHEN 'weak_routes_only' THEN 'weak' ELSE 'gap' END AS status, missing, questions, not_searched, n_edges,
        CASE WHEN result = 'weak_routes_only' THEN n_some ELSE 0 END AS n_leads FROM reported""",
    "gap_leads": f"""{_R} SELECT id, edge_id, confidence, {_quoted(gaps.LOW_LEAD)} AS why FROM reported JOIN incident ON nid = id WHERE result = 'weak_routes_only' AND (NOT here OR role IN ('study', 'partner'))""",
    "gap_sources": f"""{_G}, k AS (SELECT id FROM nodes WHERE type IN ('disease', 'gene')), s AS (SELECT * FROM (VALUES ('monarch', '2024'), ('go', NULL), ('reporter', NULL), ('pubmed', '2025')) v(source, version)),
        f AS (SELECT nid AS id, source, count(*) AS n FROM (SELECT source_id AS nid, source FROM edges UNION ALL SELECT target_id, source FROM edges WHERE source_id <> target_id) WHERE nid IN (FROM k) GROUP BY ALL)
        SELECT coalesce(a.id, f.id) AS id, coalesce(a.source, f.source) AS source, version, coalesce(n, 0) AS n FROM (SELECT * FROM k, s) a FULL JOIN f ON a.id = f.id AND a.source = f.source""",
    "gap_instead_of_paths": f"""{_R}, p AS (SELECT DISTINCT 'N:' || c_nationkey AS from_id, 'P:' || l_partkey AS to_id FROM lines WHERE l_returnflag = 'A'), q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM edges WHERE source_id = from_id AND target_id = to_id)),
        w AS (SELECT q.*, CASE WHEN t.result = 'supported' THEN from_id ELSE to_id END AS about FROM q LEFT JOIN reported t ON t.id = to_id) SELECT from_id, to_id, about AS id, result, missing FROM w LEFT JOIN reported r ON r.id = about""",
}
