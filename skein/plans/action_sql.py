"""The queries of walks, partners, assets and hypotheses as SQL, level by level, written apart from the Spark plans."""

from __future__ import annotations

from skein.operators.walk import BY_GENE, BY_MECHANISM, LINKED, OTHER_ASSET, OWN_ASSET, OWN_FACTS, STUDY_OF, TRANSFER, TRY_GENE, TRY_STUDY, VERBS
from skein.plans.star_sql import SQL as _STAR, _G, ENDS


def _said(template: str, *values: str) -> str:
    """A template with its values, as SQL."""
    parts = ["'" + p.replace("'", "''") + "'" for p in template.split("%s")]
    return " || ".join(x for pair in zip(parts, [*values, ""]) for x in pair if x)


_HOP = "{'source_id': e.source_id, 'relation': relation, 'target_id': e.target_id, 'id': e.id, 'confidence': confidence}"


def walk_sql(depth: int, studies: bool, p: str = "") -> str:
    """{p}reached(start_id, id, type, path): a common table a level, each without what earlier ones have. p begins all names."""
    bridge = "relation IN ('caused_by', 'risk_factor_for', 'participates_in') AND n.type IN ('disease', 'gene', 'mechanism')"
    trial = "OR (relation = 'studies_condition' AND n.type = 'study')" if studies else ""
    levels = [f"{p}l0 AS (SELECT id AS start_id, id, type, [] AS path FROM nodes WHERE type = 'disease')"]
    levels.append(f"{p}hops AS MATERIALIZED (SELECT node_id, other_id, n.type, relation, {_HOP} AS hop FROM ends e JOIN nodes n ON other_id = n.id WHERE ({bridge}) {trial})")
    for k in range(1, depth + 1):
        open_ = "" if k == 1 else "AND l.type NOT IN ('disease', 'study') AND s.relation <> 'studies_condition'"
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {p}l{j} o WHERE o.start_id = l.start_id AND o.id = s.other_id)" for j in range(k))
        path = "[s.hop]" if k == 1 else "list_append(l.path, s.hop)"
        levels.append(f"{p}l{k} AS MATERIALIZED (SELECT l.start_id, s.other_id AS id, s.type, min({path}) AS path FROM {p}l{k - 1} l JOIN {p}hops s ON l.id = s.node_id WHERE true {open_} {seen} GROUP BY ALL)")
    none = "CAST([] AS STRUCT(source_id VARCHAR, relation VARCHAR, target_id VARCHAR, id VARCHAR, confidence DOUBLE)[])"
    levels.append(f"{p}reached AS MATERIALIZED (SELECT start_id, id, type, {none} AS path FROM {p}l0 " + " ".join(f"UNION ALL SELECT * FROM {p}l{k}" for k in range(1, depth + 1)) + ")")
    return ",\n".join(levels)


_IDS = "list_transform({0}, lambda x: x.id)"
_LEAST = "list_min(list_transform({0}, lambda x: x.confidence))"
#: via of rows of a table (start_id, key, path): labels of the genes and mechanisms on the path, in order of their first place.
_VIA = """{name}_ends AS (SELECT start_id, {key}, unnest(flatten(list_transform(path, lambda x: [x.source_id, x.target_id]))) AS end_id, unnest(range(2 * len(path))) AS pos FROM {name}),
{name}_first AS (SELECT start_id, {key}, end_id, min(pos) AS pos FROM {name}_ends GROUP BY ALL),
{name}_via AS (SELECT start_id, {key}, string_agg(label, ', ' ORDER BY pos) AS via FROM {name}_first JOIN nodes ON end_id = nodes.id AND type IN ('gene', 'mechanism') GROUP BY ALL)"""

_PARTNERS = f"""{walk_sql(2, True, "p")},
ways AS (SELECT start_id, other_id AS partner, r.id, r.type, list_append(path, {_HOP}) AS path FROM preached r JOIN ends e ON e.node_id = r.id JOIN nodes o ON other_id = o.id AND o.type IN ('patient_group', 'funder') WHERE relation IN ('represents', 'funds')),
best AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY start_id, partner ORDER BY len(path), {_LEAST.format("path")} DESC, {_IDS.format("path")}) = 1),
{_VIA.format(name="best", key="partner")},
partners AS (SELECT b.start_id, b.partner, CAST(len(path) AS INT) AS n_edges, {_LEAST.format("path")} AS least, array_to_string({_IDS.format("path")}, ',') AS edge_ids,
  CASE path[-1].relation WHEN 'represents' THEN '{VERBS["represents"]}' ELSE '{VERBS["funds"]}' END || n.label ||
  CASE WHEN b.type = 'study' THEN {_said(STUDY_OF, "s.label")} WHEN b.id <> b.start_id THEN {_said(LINKED, "s.label", "coalesce(via, b.start_id)")} ELSE '' END AS why
  FROM best b JOIN nodes n ON b.id = n.id JOIN nodes s ON b.start_id = s.id LEFT JOIN best_via v ON b.start_id = v.start_id AND b.partner = v.partner)"""
_RANKED = "SELECT *, CAST(row_number() OVER (PARTITION BY start_id ORDER BY n_edges, least DESC, partner) AS INT) AS rank FROM partners"

_KNOWN = """known AS MATERIALIZED (SELECT 'O:' || o_orderkey AS id, o_orderstatus = 'P' AS curated, CASE WHEN o_orderstatus = 'O' THEN 'RECRUITING' WHEN o_orderstatus = 'P' THEN 'ACTIVE_NOT_RECRUITING' WHEN o_orderpriority = '1-URGENT' THEN 'TERMINATED' ELSE 'COMPLETED' END AS status,
  o_orderpriority[1] AS phase, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey, CASE WHEN o_orderstatus = 'P' THEN coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'dose ' || o_custkey || ' mg; ' END, '') || 'design open label' ELSE '' END AS facts,
  o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS dosed FROM orders)"""


def _assets(cap: str) -> str:
    return f"""{_KNOWN}, {walk_sql(4, False)},
near AS (SELECT *, CASE WHEN len(path) = 0 THEN 0 WHEN len(list_filter(path, lambda x: x.relation = 'participates_in')) > 0 THEN 2 ELSE 1 END AS tier FROM reached WHERE type = 'disease'),
paths AS (SELECT start_id, other_id AS asset, tier, r.id AS near, list_append(path, {_HOP}) AS path, o.type AS kind, o.label AS name, coalesce(curated, false) AS curated FROM near r JOIN ends e ON e.node_id = r.id JOIN nodes o ON other_id = o.id AND o.type IN ('study', 'publication', 'asset') LEFT JOIN known k ON other_id = k.id),
once AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY start_id, asset ORDER BY tier, NOT curated, path[-1].confidence DESC, len(path), asset, {_IDS.format("path")}) = 1),
first AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY start_id{", tier" if cap == "tier" else ""} ORDER BY tier, NOT curated, path[-1].confidence DESC, len(path), asset, {_IDS.format("path")}) AS rank FROM once QUALIFY rank <= {10 if cap == "tier" else 25}),
{_VIA.format(name="first", key="asset")},
own AS (SELECT node_id AS start_id, o.label || ' (' || facts || ')' AS own FROM ends e JOIN known k ON other_id = k.id AND dosed JOIN nodes o ON other_id = o.id QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY e.source_id, relation, e.target_id, e.id) = 1),
told AS MATERIALIZED (SELECT f.start_id, tier, f.rank, f.asset, kind, name, s.label AS start, coalesce(via, f.start_id) AS via, CAST(len(path) AS INT) AS n_edges, array_to_string({_IDS.format("path")}, ',') AS edge_ids, k.size, f.curated, k.status,
  'Interventional study, phase ' || phase || ', ' || replace(lower(status), '_', ' ') || ', ' || k.size || ' participants{TRANSFER}' AS reusable,
  CASE WHEN tier = 0 THEN {_said(OWN_ASSET, "s.label")} ELSE {_said(OTHER_ASSET, "n.label", "s.label", f"CASE WHEN tier = 1 THEN '{BY_GENE}' ELSE '{BY_MECHANISM}' END", "coalesce(via, f.start_id)", "s.label")} END ||
  CASE WHEN facts <> '' THEN {_said(OWN_FACTS, "facts")} ELSE '' END || CASE WHEN tier > 0 AND own IS NOT NULL THEN ' For ' || s.label || ' the closest clinical evidence is ' || own || '.' ELSE '' END ||
  CASE WHEN status = 'TERMINATED' THEN ' Status terminated: customer ' || o_custkey || '.' ELSE '' END AS differs
  FROM first f JOIN nodes s ON f.start_id = s.id JOIN nodes n ON near = n.id LEFT JOIN first_via v ON f.start_id = v.start_id AND f.asset = v.asset LEFT JOIN known k ON f.asset = k.id LEFT JOIN own ON f.start_id = own.start_id)"""


_STEPS = f"""genes AS (SELECT node_id AS start_id, other_id AS gene, e.id, count(*) OVER (PARTITION BY other_id) AS n, e.source_id, relation, e.target_id FROM ends e WHERE relation IN ('caused_by', 'risk_factor_for')),
gene AS (SELECT g.start_id, {_said(TRY_GENE, "o.label", "s.label", "o.label")} AS text, g.id AS edge_ids FROM genes g JOIN nodes s ON g.start_id = s.id AND s.type = 'disease' JOIN nodes o ON gene = o.id
  QUALIFY row_number() OVER (PARTITION BY g.start_id ORDER BY n DESC, gene, g.source_id, relation, g.target_id, g.id) = 1),
study AS (SELECT start_id, {_said(TRY_STUDY, "start", "via", "name", "start")} AS text, edge_ids FROM told WHERE n_edges > 1 AND kind = 'study'
  QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY status NOT IN ('RECRUITING', 'ACTIVE_NOT_RECRUITING'), NOT curated, size DESC, tier, rank) = 1),
steps AS (SELECT coalesce(s.start_id, g.start_id) AS start_id, coalesce(s.text, g.text) AS text, coalesce(s.edge_ids, g.edge_ids) AS edge_ids FROM study s FULL JOIN gene g ON s.start_id = g.start_id)"""

#: The tables of the query of information content, and then its own rows.
_IC_TABLES, _, _IC_ROWS = _STAR["information_content"].removeprefix(_G).lstrip(", \n").rpartition("SELECT term, n,")
_FOCUS = f"""{_IC_TABLES}, ic0 AS (SELECT term, n, {_IC_ROWS}),
hop AS MATERIALIZED (SELECT node_id, other_id, n.type, max(confidence) AS c FROM ends e JOIN nodes n ON other_id = n.id WHERE confidence >= 0.55e0 GROUP BY ALL),
f1 AS MATERIALIZED (SELECT d.id AS center, other_id AS id, h.type, max(c) AS best FROM nodes d JOIN hop h ON d.id = node_id WHERE d.type = 'disease' AND other_id <> d.id GROUP BY ALL),
f2 AS MATERIALIZED (SELECT center, other_id AS id, h.type, max(c) AS best FROM f1 JOIN hop h ON f1.id = node_id WHERE f1.type <> 'phenotype' AND other_id <> center AND NOT EXISTS (SELECT 1 FROM f1 o WHERE o.center = f1.center AND o.id = other_id) GROUP BY ALL),
reach2 AS (SELECT *, 1 AS distance FROM f1 UNION ALL SELECT *, 2 FROM f2),
can AS (SELECT r.*, list_position(['disease', 'gene', 'variant', 'mechanism', 'patient_group', 'funder', 'asset', 'study', 'publication', 'investigator', 'phenotype'], r.type) AS t, coalesce(ic, 0e0) AS w, lower(label) AS l FROM reach2 r JOIN nodes n ON r.id = n.id LEFT JOIN ic0 ON ic0.term = r.id WHERE r.type <> 'phenotype'),
cut AS (SELECT * FROM can QUALIFY row_number() OVER (PARTITION BY center, type ORDER BY distance, t, best DESC, w DESC, l, id) <= CASE type WHEN 'investigator' THEN 12 WHEN 'study' THEN 24 ELSE 30 END),
drawn2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY center ORDER BY distance, t, best DESC, w DESC, l, id) AS place FROM cut QUALIFY place <= 150)"""
_ANNOTATED = """a AS MATERIALIZED (SELECT 'S:' || l_suppkey AS thing, 'P:' || l_partkey AS term, CASE l_returnflag WHEN 'R' THEN 'ECO:0000314' WHEN 'A' THEN 'ECO:0000501' END AS code, 'PMID:' || l_orderkey AS pub,
  list_sort(list_filter(['B:' || p_brand] || tt, lambda x: x IN ('T:LARGE', 'T:SMALL', 'B:Brand#1', 'B:Brand#12', 'none'))) AS matched FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT p_brand AS b, list(DISTINCT 'T:' || p_type) AS tt FROM part GROUP BY 1) ON b = p_brand),
m AS MATERIALIZED (SELECT * FROM a WHERE len(matched) > 0), e AS MATERIALIZED (SELECT thing, unnest(matched) AS target, term, code, pub FROM m)"""
_TOP = "array_to_string(list_sort(list(DISTINCT {0}))[:8], ',')"
_GAPS = ", ".join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM ends WHERE node_id = d.id AND relation = '{r}') THEN '{name}' END" for name, r in (("phenotypes", "has_phenotype"), ("causes", "caused_by"), ("studies", "investigates")))
SQL = {
    "focus_map": f"{_G}, {ENDS}, {_FOCUS} SELECT center, place, id, type, distance, best FROM drawn2",
    "focus_left_out": f"{_G}, {ENDS}, {_FOCUS} SELECT center, type, count(*) AS n FROM reach2 r WHERE NOT EXISTS (SELECT 1 FROM drawn2 x WHERE x.center = r.center AND x.id = r.id) GROUP BY 1, 2",
    "closure_scan": f"WITH {_ANNOTATED} SELECT term, count(*) AS n, any_value(array_to_string(matched, ',')) AS matched FROM m GROUP BY term",
    "annotation_groups": f"""WITH {_ANNOTATED} SELECT thing, target, count(*) AS annotation_count, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS evidence_codes, {_TOP.format("term")} AS annotated_terms,
        {_TOP.format("pub")} AS publications, CASE WHEN count(*) FILTER (code = 'ECO:0000314') > 0 THEN 0.9e0 ELSE 0.7e0 END AS confidence FROM e GROUP BY 1, 2""",
    "typed_walk": f"{_G}, {ENDS}, {walk_sql(4, False)} SELECT start_id, id, type, CAST(len(path) AS INT) AS n_edges, array_to_string({_IDS.format('path')}, ',') AS edge_ids FROM reached",
    "action_bundle": f"""{_G}, {ENDS}, {_PARTNERS}, r AS ({_RANKED}), {_assets('whole')}, {_STEPS},
        w AS (SELECT start_id, count(*) AS n_partners, arg_min(partner, rank) AS first_partner FROM r GROUP BY 1), a AS (SELECT start_id, count(*) AS n_assets, arg_min(asset, rank) AS first_asset, max(tier) AS last_tier FROM told GROUP BY 1)
        SELECT d.id AS start_id, coalesce(n_partners, 0) AS n_partners, first_partner, coalesce(n_assets, 0) AS n_assets, first_asset, last_tier, text AS next_step, edge_ids AS step_ids,
          CASE WHEN n_partners IS NULL OR n_assets IS NULL THEN array_to_string(list_filter([{_GAPS}], lambda x: x IS NOT NULL), ',') END AS missing
        FROM nodes d LEFT JOIN w ON d.id = w.start_id LEFT JOIN a ON d.id = a.start_id LEFT JOIN steps ON d.id = steps.start_id WHERE d.type = 'disease'""",
    "action_partners": f"{_G}, {ENDS}, {_PARTNERS} {_RANKED}",
    "reusable_assets": f"{_G}, {ENDS}, {_assets('tier')} SELECT start_id, tier, rank, asset, n_edges, edge_ids, reusable, differs FROM told",
    "next_hypotheses": f"{_G}, {ENDS}, {_assets('tier')}, {_STEPS} SELECT start_id, text, edge_ids FROM steps",
}
