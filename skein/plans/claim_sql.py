"""The queries of claims as SQL, written apart from the Spark plans."""

from __future__ import annotations

from skein.operators.claims import CANDIDATE_TYPES, CERTAINTIES, CLAIM_RELATIONS, POLARITIES
from skein.plans.star_sql import NODES, _G, r4

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_pick = lambda values, n: f"{_list(values)}[({n}) % {len(values)} + 1]"

CHECKED = rf"""
g AS (SELECT doc_id, text, unnest([0, 1, 2, 3]) AS seq FROM documents),
w AS (SELECT g.doc_id, 'model-' || g.doc_id % 2 AS model, seq, CASE WHEN (g.doc_id + seq) % 3 = 2 THEN 'B:Brand#' || (g.doc_id + seq) % 27 ELSE 'N:' || g.doc_id % 25 END AS subject_id,
  {_pick((*CLAIM_RELATIONS, "knows"), "g.doc_id")} AS relation,
  CASE WHEN (g.doc_id + seq) % 3 = 0 THEN 'B:Brand#' || (g.doc_id + seq) % 27 WHEN (g.doc_id + seq) % 11 = 1 THEN 'N:' || g.doc_id % 25 ELSE 'T:' || ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][(g.doc_id + seq) % 6 + 1] END AS object_id,
  {_SQUEEZED.format("coalesce(substr(b.text, 1, 40), substr(g.text, 11, 60))")} AS quote, {_pick((*POLARITIES, "supports", "supports", "denies"), "g.doc_id // 7")} AS polarity,
  nullif({_pick((*CERTAINTIES, "", "low", "high", "low"), "(g.doc_id + seq) // 5")}, '') AS certainty, {_SQUEEZED.format("g.text")} AS t
  FROM g LEFT JOIN benchmark b ON (g.doc_id + seq) % 4 = 1 AND b.item_id = g.doc_id % 40),
k AS (SELECT id FROM nodes WHERE type IN {_in(CANDIDATE_TYPES)}),
j AS (SELECT *, CASE WHEN subject_id NOT IN (SELECT id FROM k) OR object_id NOT IN (SELECT id FROM k) THEN 'unknown id' WHEN subject_id = object_id THEN 'self' WHEN relation NOT IN {_in(CLAIM_RELATIONS)} THEN 'relation'
  WHEN polarity NOT IN {_in(POLARITIES)} THEN 'polarity' WHEN certainty IS NULL OR certainty NOT IN {_in(CERTAINTIES)} THEN 'certainty' WHEN quote IS NULL OR quote = '' THEN 'no quote' WHEN NOT contains(t, quote) THEN 'quote not found' END AS p FROM w),
checked AS MATERIALIZED (SELECT *, CASE WHEN p IS NULL AND row_number() OVER (PARTITION BY doc_id, model, subject_id, relation, object_id, p IS NULL ORDER BY seq) > 1 THEN 'repeated' ELSE p END AS problem FROM j),
valid AS (SELECT * FROM checked WHERE problem IS NULL)"""

MADE = f"""{CHECKED},
parts AS (SELECT subject_id AS source_id, relation, object_id AS target_id, 'openai:' || model AS source, 'PMID:' || doc_id AS record_id, CASE certainty WHEN 'high' THEN 0.6e0 WHEN 'medium' THEN 0.45e0 ELSE 0.3e0 END AS confidence, certainty AS qualifier, polarity, quote FROM valid
  UNION ALL SELECT 'PMID:' || doc_id, 'mentions', x, 'openai:' || model, 'PMID:' || doc_id, 0.3e0, NULL, NULL, arg_min(quote, {{'s': subject_id, 'r': relation, 'o': object_id}})
  FROM (SELECT *, unnest([subject_id, object_id]) AS x FROM valid) GROUP BY doc_id, model, x),
made AS (SELECT 'E:' || substr(sha256('["' || source_id || '","' || relation || '","' || target_id || '","' || source || '","' || record_id || '"]'), 1, 16) AS id, source_id, relation, target_id, source, record_id, confidence, 'inferred' AS evidence_type, qualifier, polarity, quote FROM parts)"""
_ESCAPED = "replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
_N = f"WITH {NODES}"
SQL = {
    "claim_problems": f"{_N}, {CHECKED} SELECT doc_id, seq, coalesce(problem, '') AS problem FROM checked",
    "claim_edges": f"{_N}, {MADE} SELECT * FROM made",
    "claim_publications": f"""{_N}, {CHECKED} SELECT 'PMID:' || doc_id AS id, 'publication' AS type, coalesce(title, 'PMID:' || doc_id) AS label,
        '{{' || array_to_string(list_filter(['"title":"' || {_ESCAPED.format("title")} || '"', '"journal":"' || nullif(lang, '') || '"'], lambda x: x IS NOT NULL), ',') || '}}' AS attributes
        FROM (SELECT doc_id, lang, nullif({_SQUEEZED.format("substr(text, 1, 50)")}, '') AS title FROM documents WHERE doc_id IN (SELECT doc_id FROM valid))""",
    "claim_keys": f"""{_N}, h AS (SELECT DISTINCT sha256('["' || id || '","' || label || '"]') AS h FROM nodes WHERE type IN {_in(CANDIDATE_TYPES)}), b AS (SELECT h[:3] AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h GROUP BY 1),
        v AS (SELECT substr(sha256(string_agg(h, ',' ORDER BY b)), 1, 16) AS v FROM b) SELECT doc_id, sha256('["model-1","extract-v1","' || doc_id || '","' || v || '"]') AS key FROM documents, v""",
    "extraction_stage": f"""{_N}, {CHECKED} SELECT model, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) FILTER (problem IS NULL) AS n_records, count(*) FILTER (problem IS NULL) AS n_claims, count(*) FILTER (problem IS NOT NULL) AS n_dropped,
        count(*) FILTER (problem = 'repeated') AS n_repeated, count(*) FILTER (problem = 'quote not found') AS n_unquoted FROM checked GROUP BY model""",
    "claims_in_dispute": f"""{_N}, {MADE}, p AS (SELECT source_id, relation, target_id, record_id, max(polarity = 'contradicts') AS against FROM made WHERE polarity IS NOT NULL GROUP BY ALL)
        SELECT source_id, relation, target_id, count(*) FILTER (NOT against) AS n_for, count(*) FILTER (against) AS n_against FROM p GROUP BY ALL HAVING n_for > 0 AND n_against > 0""",
    "claims_against_graph": f"""{_G}, {CHECKED}, c AS (SELECT DISTINCT doc_id, subject_id, relation, object_id FROM valid), s AS (SELECT DISTINCT source_id, relation, target_id FROM edges)
        SELECT c.relation, count(*) AS n_claims, count(DISTINCT doc_id) AS n_publications, count(source_id) AS n_known FROM c LEFT JOIN s ON subject_id = source_id AND object_id = target_id AND s.relation = c.relation GROUP BY 1""",
    "claims_rescored": f"""{_N}, {MADE}, s AS (SELECT source_id, relation, target_id, count(DISTINCT record_id) AS n, string_agg(DISTINCT record_id, ', ' ORDER BY record_id) AS names FROM made GROUP BY ALL),
        r AS (SELECT m.*, n, names, CASE WHEN m.relation = 'mentions' THEN 'low' ELSE qualifier END AS c FROM made m JOIN s ON m.source_id = s.source_id AND m.relation = s.relation AND m.target_id = s.target_id),
        v AS (SELECT *, CASE c WHEN 'high' THEN 0.45e0 WHEN 'medium' THEN 0.35e0 ELSE 0.25e0 END AS base, CASE WHEN n >= 2 THEN least(0.05e0 * (n - 1), 0.15e0) ELSE 0e0 END AS bonus FROM r)
        SELECT id, source_id, relation, target_id, evidence_type, confidence, 'inferred_' || c AS rule, n AS n_sources, 0 AS n_disputes, {r4("least(greatest(base + bonus - 0.15e0 * 0, 0.05e0), 0.49e0)")} AS score,
          CASE WHEN c = 'low' THEN 'OpenAI Extract claim or mention, low (hypothesis)' ELSE 'OpenAI Extract claim, certainty ' || c || ' (hypothesis)' END || printf(' %.2f', base) ||
          CASE WHEN n >= 2 THEN printf('; +%.2f corroborated by %d sources (', bonus, n) || names || ')' ELSE '' END || CASE WHEN base + bonus > 0.49e0 THEN '; capped at 0.49: inferred stays below curated' ELSE '' END AS reasons FROM v""",
}
