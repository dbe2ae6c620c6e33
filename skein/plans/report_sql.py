"""SQL twins of the catalogue's second part, written apart from the Spark plans to check them."""

from __future__ import annotations

from skein.plans.star_sql import _G, CLUSTERS, ENDS, PROFILES, r4

_REGIONS = "regions AS (SELECT 'N:' || n_nationkey AS id, 'C' || (n_regionkey + 1) AS cluster FROM nation)"
_FEATURES = """
held AS (SELECT cluster, kind, feature, count(*) AS n, max(weight) AS weight FROM profiles p JOIN regions r ON p.thing = r.id GROUP BY ALL HAVING count(*) >= 2),
everywhere AS (SELECT kind, feature, count(*) AS total FROM profiles GROUP BY ALL),
features AS (
  SELECT cluster, kind, row_number() OVER (PARTITION BY cluster, kind ORDER BY CASE WHEN kind = 'phenotype' THEN -weight ELSE 0 END, n DESC, CASE WHEN kind = 'mechanism' THEN total ELSE 0 END, feature) AS rank, feature, n
  FROM held JOIN everywhere USING (kind, feature) QUALIFY rank <= 5)"""
_VECTORS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id, floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) * 10000 + 0.5) / 10000 AS score FROM q JOIN embeddings ON vec_id <> query_id),
  r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)"""

SQL = {
    "cluster_ids": f"{_G}, {PROFILES}, {CLUSTERS} SELECT id, cluster FROM clusters",
    "cluster_features": f"{_G}, {PROFILES}, {_REGIONS}, {_FEATURES} SELECT cluster, kind, rank, feature, n FROM features",
    "cluster_labels": f"""{_G}, {PROFILES}, {_REGIONS}, {_FEATURES},
        f AS (SELECT cluster, max(label) FILTER (kind = 'gene') AS gene, max(label) FILTER (kind = 'mechanism') AS mechanism, max(label) FILTER (kind = 'phenotype') AS phenotype FROM features JOIN nodes ON feature = id WHERE rank = 1 GROUP BY cluster),
        m AS (SELECT cluster, count(*) AS size, min(id) AS id FROM regions GROUP BY cluster)
        SELECT m.cluster, size, coalesce(nullif(concat_ws(' · ', gene, mechanism), ''), 'shared phenotype: ' || phenotype, nodes.label) AS label FROM m JOIN nodes USING (id) LEFT JOIN f ON m.cluster = f.cluster""",
    "cluster_bridges": f"""{_G}, {PROFILES}, {_REGIONS}, x AS (SELECT a, b, score, ra.cluster AS ca, rb.cluster AS cb FROM pairs JOIN regions ra ON a = ra.id JOIN regions rb ON b = rb.id WHERE ra.cluster <> rb.cluster AND score >= 0.05),
        e AS (SELECT ca AS cluster, a AS member, b AS other, cb AS other_cluster, a, b, score FROM x UNION ALL SELECT cb, b, a, ca, a, b, score FROM x)
        SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, a, b) AS rank, member, other, other_cluster, score FROM e QUALIFY rank <= 6""",
    "counterexamples": f"""{_G}, {PROFILES}, {_REGIONS}, g AS (SELECT feature, thing, cluster, label FROM profiles JOIN regions ON thing = regions.id JOIN nodes ON feature = nodes.id WHERE kind = 'gene')
        SELECT x.cluster, row_number() OVER (PARTITION BY x.cluster ORDER BY x.label, coalesce(score, 0) DESC, x.thing, y.thing) AS rank, x.label AS gene, x.thing AS member, y.thing AS other, y.cluster AS other_cluster, coalesce(score, 0e0) AS score
        FROM g x JOIN g y ON x.feature = y.feature AND x.cluster <> y.cluster LEFT JOIN pairs ON least(x.thing, y.thing) = a AND greatest(x.thing, y.thing) = b QUALIFY rank <= 8""",
    "similarity_degree": f"{_G}, {PROFILES} SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pairs WHERE score >= 0.1 UNION ALL SELECT b FROM pairs WHERE score >= 0.1) GROUP BY id",
    "mechanism_frequency": f"{_G}, {PROFILES} SELECT feature AS mechanism, count(*) AS n FROM profiles WHERE kind = 'mechanism' GROUP BY 1",
    "pair_reasons": f"""{_G}, {PROFILES}, m AS (SELECT x.kind, x.thing AS a, y.thing AS b, x.feature, label FROM profiles x JOIN profiles y ON x.kind = y.kind AND x.feature = y.feature AND x.thing < y.thing JOIN nodes ON x.feature = id WHERE x.kind IN ('gene', 'mechanism')),
        t AS (SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY feature) AS r FROM m), w AS (SELECT a, b, string_agg(label, ', ' ORDER BY r) FILTER (kind = 'gene') AS genes, string_agg(label, ', ' ORDER BY r) FILTER (kind = 'mechanism') AS mechanisms FROM t WHERE r <= 3 GROUP BY a, b)
        SELECT a, b, concat_ws('; ', 'shares gene ' || genes, 'shares GO mechanism via its genes: ' || mechanisms || CASE WHEN n_mechanism > 3 THEN ' and ' || (n_mechanism - 3) || ' more' ELSE '' END) AS reasons FROM pairs JOIN w USING (a, b)""",
    "node_cards": f"""{_G}, {ENDS}, c AS (SELECT node_id, count(*) AS n_edges, count(DISTINCT other_id) AS n_neighbours, count(*) FILTER (evidence_type = 'inferred') AS n_inferred, max(confidence) AS best FROM ends GROUP BY 1),
        f AS (SELECT node_id, id AS first_edge FROM ends QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY relation = 'has_phenotype', confidence DESC, id) = 1)
        SELECT n.id, type, label, coalesce(n_edges, 0) AS n_edges, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(n_inferred, 0) AS n_inferred, coalesce(best, 0e0) AS best, first_edge FROM nodes n LEFT JOIN c ON n.id = c.node_id LEFT JOIN f ON n.id = f.node_id""",
    "meta": f"{_G} SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT relation) AS n_relations FROM edges",
    "coverage_other": f"""{_G}, {ENDS}, c AS (SELECT node_id AS id, count(*) FILTER (relation = 'caused_by') AS diseases, count(*) FILTER (relation = 'participates_in') AS mechanisms, count(*) FILTER (evidence_type <> 'inferred' AND confidence >= 0.4) AS n_strong FROM ends GROUP BY 1),
        d AS (SELECT n.id, label, coalesce(diseases, 0) AS diseases, coalesce(mechanisms, 0) AS mechanisms, coalesce(n_strong, 0) AS n_strong FROM nodes n LEFT JOIN c ON n.id = c.id WHERE type = 'gene')
        SELECT *, array_to_string(list_filter([CASE WHEN diseases = 0 THEN 'diseases' END, CASE WHEN mechanisms = 0 THEN 'mechanisms' END], lambda x: x IS NOT NULL), ',') AS missing,
          CASE WHEN diseases = 0 AND mechanisms = 0 THEN 'gap' WHEN diseases > 0 AND mechanisms > 0 AND n_strong > 0 THEN 'supported' ELSE 'weak' END AS status FROM d""",
    "weak_leads": f"""{_G} SELECT target_id, n_name AS disease, count(*) AS n_leads, min(confidence) AS least, min(id) AS first FROM edges JOIN nation ON target_id = 'N:' || n_nationkey
        WHERE relation IN ('studies_condition', 'represents') AND (confidence < 0.7 OR evidence_type = 'inferred') GROUP BY 1, 2""",
    "partner_paths": f"""{_G}, p AS (SELECT target_id AS disease, source_id AS partner, 1 AS n_edges, confidence AS least, id AS path FROM edges WHERE relation = 'represents'
          UNION ALL SELECT i.target_id, f.source_id, 2, least(i.confidence, f.confidence), i.id || ',' || f.id FROM edges i JOIN edges f ON i.source_id = f.target_id WHERE i.relation = 'investigates' AND f.relation = 'funds')
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY disease, partner ORDER BY n_edges, least DESC, path) = 1""",
    "investigator_bridges": f"""{_G}, {_REGIONS}, b AS (SELECT source_id AS investigator, list_sort(list(DISTINCT cluster)) AS c, count(DISTINCT target_id) AS n_targets, CAST(sum(CAST(qualifier AS BIGINT)) AS BIGINT) AS n_projects FROM edges e JOIN regions r ON e.target_id = r.id WHERE relation = 'investigates' GROUP BY 1 HAVING count(DISTINCT cluster) >= 2)
        SELECT investigator, n_targets, n_projects, row_number() OVER (ORDER BY len(c) DESC, n_targets DESC, n_projects DESC, investigator) AS rank, n_projects || ' project' || CASE WHEN n_projects = 1 THEN '' ELSE 's' END || ' in ' || array_to_string(c, ' + ') AS why FROM b QUALIFY rank <= 30""",
    "relevant_bridges": f"""{_G}, g AS (SELECT source_id AS disease, target_id AS gene FROM edges WHERE relation = 'caused_by'), n AS (SELECT DISTINCT x.disease, y.disease AS other FROM g x JOIN g y USING (gene))
        SELECT disease, count(DISTINCT source_id) AS n_investigators, count(DISTINCT other) AS n_targets FROM n JOIN edges e ON e.target_id = other AND relation = 'investigates' GROUP BY disease""",
    "shared_gene_degree": f"""{_G}, g AS (SELECT DISTINCT source_id AS disease, target_id AS gene FROM edges WHERE relation = 'caused_by'), n AS (SELECT gene, count(*) AS n FROM g GROUP BY gene)
        SELECT disease, gene, n FROM g JOIN n USING (gene) QUALIFY row_number() OVER (PARTITION BY disease ORDER BY n DESC, gene) = 1""",
    "search_semantic": f"WITH {_VECTORS} SELECT query_id, vec_id, floor(score * 0.8e0 * 10000 + 0.5) / 10000 AS score FROM r WHERE query_id % 40 <> 0 AND score >= 0.45",
    "interleaved_hits": """WITH l AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS no, o_orderkey AS item, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
        SELECT item, row_number() OVER (ORDER BY r, no, item) AS place FROM l WHERE r <= 40 QUALIFY place <= 60""",
    "projects_per_target": f"{_G} SELECT target_id, count(DISTINCT source_id) AS n_investigators, CAST(sum(CAST(qualifier AS BIGINT)) AS BIGINT) AS n_projects FROM edges WHERE relation = 'investigates' GROUP BY 1",
    "latest_order_per_customer_and_status": "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "story_checks": f"""{_G}, w AS (SELECT unnest(['caused_by', 'participates_in', 'has_phenotype', 'investigates', 'funds', 'claims']) AS relation)
        SELECT w.relation, count(id) AS n, (count(id) > 0) <> (w.relation = 'claims') AS holds FROM w LEFT JOIN edges e ON e.relation = w.relation GROUP BY w.relation""",
    "record_fields": """SELECT p_partkey, 'Orphanet:' || p_partkey || ',OMIM:' || p_size AS xrefs, p_type AS synonyms, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS spelt, p_size || ' part' || CASE WHEN p_size = 1 THEN '' ELSE 's' END AS counted,
        p_brand || '|' || p_type AS listed, CASE WHEN p_type = 'STANDARD' THEN 'P:' || p_partkey ELSE p_type END AS stub,
        CASE WHEN p_size > 25 THEN 'NCT:NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') WHEN p_size > 10 THEN 'PMID:' || p_partkey ELSE 'asset:' || p_brand END AS asset FROM part""",
    "attribute_maps": """SELECT c_custkey, '{"key":"' || c_custkey || '","nation":"N:' || c_nationkey || '","segment":"' || c_mktsegment || '"}' AS attributes FROM customer""",
    "usable_numbers": f"SELECT o_orderkey, {r4('o_totalprice')} AS value FROM orders WHERE o_orderkey % 5 > 2 AND o_totalprice > 0",
    "request_ids": """WITH f AS (SELECT l_orderkey, 'P:' || l_partkey AS id, min({'n': l_linenumber, 'p': l_partkey}) AS first FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, CASE WHEN count(*) <= 4 THEN string_agg(id, ',' ORDER BY first) END AS ids FROM f GROUP BY l_orderkey""",
    "first_sentences": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT doc_id, trim(string_split(t, '. ')[1]) AS h FROM t)
        SELECT doc_id, CASE WHEN h LIKE '%.' THEN h ELSE h || '.' END AS sentence FROM h""",
    "registry_names": "SELECT p_partkey, lower(p_name) || ' type ' || CASE WHEN p_size % 2 = 0 THEN '4' ELSE 'vi' END AS name FROM part",
    "client_events": "SELECT CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id WHEN user_id % 2 = 0 THEN 'peer' || user_id ELSE 'unknown' END AS client, count(*) AS n FROM events GROUP BY 1",
    "daily_events": "WITH d AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n_days, max(n) AS most, CAST(sum(cents) AS BIGINT) AS cents FROM d GROUP BY 1",
}
