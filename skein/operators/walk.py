"""The typed walk from diseases through genes and mechanisms, and what it leads to: partners, reusable assets, next steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import first_sentence, literal_map
from skein.operators.graph import incidence
from skein.operators.work import saved

#: Relations that bridge, types that they lead to, types that aren't left again, and what is looked for.
BRIDGES, BRIDGE_TYPES, LEAF_TYPES = ("caused_by", "risk_factor_for", "participates_in"), ("disease", "gene", "mechanism"), ("disease", "study")
PARTNER_RELATIONS, PARTNER_TYPES, ASSET_TYPES = ("represents", "funds"), ("patient_group", "funder"), ("study", "publication", "asset")
PARTNER_EDGES, RELATED_EDGES, MOST_ASSETS = 3, 4, 25
OPEN_STATUSES = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION")
STOPPED_STATUSES = ("TERMINATED", "WITHDRAWN", "SUSPENDED")
FACTS = {"curated_population": "population", "curated_dose": "dose", "curated_duration": "duration", "curated_primary_endpoint": "primary endpoint", "curated_design": "design"}
VERBS = {"represents": "Represents ", "funds": "Funds "}
STUDY_OF, LINKED = ", a study of %s", ", linked to %s through %s"
OWN_ASSET = "Already linked to %s; check scope and eligibility before reuse."
OTHER_ASSET = "Studies %s, not %s (%s: %s); eligibility, dosing and endpoints would need re-checking for %s."
BY_GENE, BY_MECHANISM = "shared gene", "shared pathway only"
OWN_FACTS, CLOSEST, STOPPED = " This asset: %s.", " For %s the closest clinical evidence is %s.", " Status %s%s."
TRANSFER, UNSAID = ". Protocol, safety data and outcome measures may transfer.", "%s: published evidence to reuse."
TRY_STUDY = (
    "Hypothesis: %s is linked through %s to the population of %s. Check whether that study's protocol and biomarker readouts could run in a small %s cohort, "
    "starting with a feasibility review of eligibility, dosing and endpoints."
)
TRY_GENE = "Hypothesis: a functional assay of %s variants seen in %s patients would show which mechanism (and which studies) they share with other %s-linked diseases."

_HOP = ("source_id", "relation", "target_id", "id", "confidence")


def walk(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, studies: bool = False) -> DataFrame:
    """What starts (start_id) reach: (start_id, id, type, path), path the edges walked, none for the start itself.

    Breadth first over bridging relations, in both directions, to diseases, genes and mechanisms; with studies also from
    a start to the studies of it. Diseases and studies, other than the start, are not left again. Each node keeps one
    path, the shortest, of these the first in the order of its edges (source, relation, target, id). That order is a
    comparison of arrays, so a level is a join and an aggregate that Spark combines before the shuffle, for all
    starts at once, and a node in the middle of many paths costs a row a start and task.
    """
    kinds = nodes.select("id", "type")
    ends = incidence(edges.filter(F.col("relation").isin(*BRIDGES, *(["studies_condition"] if studies else [])))).join(kinds.withColumnsRenamed({"id": "other_id", "type": "other_type"}), "other_id")
    bridge = F.col("relation").isin(*BRIDGES) & F.col("other_type").isin(*BRIDGE_TYPES)
    study = (F.col("relation") == "studies_condition") & (F.col("other_type") == "study")
    steps = saved(ends.filter(bridge | study).select("node_id", "other_id", "other_type", study.alias("study"), F.struct(*_HOP).alias("hop")))
    none = F.array().cast(f"array<{steps.schema['hop'].dataType.simpleString()}>")
    seen = saved(starts.select("start_id", F.col("start_id").alias("id")).distinct().join(kinds, "id").select("start_id", "id", "type", none.alias("path")))
    front = seen
    for level in range(1, depth + 1):
        open_ = front if level == 1 else front.filter(~F.col("type").isin(*LEAF_TYPES))
        onward = open_.select("start_id", F.col("id").alias("node_id"), "path").join(steps if level == 1 else steps.filter("not study"), "node_id")
        found = onward.groupBy("start_id", F.col("other_id").alias("id"), F.col("other_type").alias("type")).agg(F.min(F.concat("path", F.array("hop"))).alias("path"))
        front = saved(found.join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti").select("start_id", "id", "type", "path"))
        seen = seen.union(front)
    return seen


def _ids(path: Column) -> Column:
    return F.transform(path, lambda e: e["id"])


def _least(path: Column) -> Column:
    return F.array_min(F.transform(path, lambda e: e["confidence"]))


def through(found: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """found (key, start_id, path) with via: the labels of the genes and mechanisms on the path, in order, else the start's id."""
    ends = F.flatten(F.transform("path", lambda e: F.array(e["source_id"], e["target_id"])))
    inner = nodes.filter(F.col("type").isin("gene", "mechanism")).select("id", "label")
    named = found.select(*key, F.posexplode(F.array_distinct(ends)).alias("pos", "id")).join(inner, "id")
    labels = named.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), ", ").alias("via"))
    return found.join(labels, key, "left").withColumn("via", F.coalesce("via", "start_id"))


def partners(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Per start the groups that represent and the funders that fund it or what it leads to, within three edges:
    (start_id, rank, partner, n_edges, least, edge_ids, why). Each has its shortest path, then the surest, then the first by ids."""
    reached = walk(nodes, edges, starts, PARTNER_EDGES - 1, studies=True)
    groups = nodes.filter(F.col("type").isin(*PARTNER_TYPES)).select(F.col("id").alias("other_id"))
    last = incidence(edges.filter(F.col("relation").isin(*PARTNER_RELATIONS))).join(groups, "other_id").select(F.col("node_id").alias("id"), F.col("other_id").alias("partner"), F.struct(*_HOP).alias("hop"))
    paths = reached.join(last, "id").select("start_id", "partner", "id", "type", F.concat("path", F.array("hop")).alias("path"))
    key = F.struct(F.size("path").alias("n"), (-_least(F.col("path"))).alias("worst"), _ids(F.col("path")).alias("ids"))
    best = saved(paths.groupBy("start_id", "partner").agg(F.min_by(F.struct("id", "type", "path"), key).alias("b")).select("start_id", "partner", "b.*"))
    label = nodes.select("id", "label")
    named = through(best, nodes, ["start_id", "partner"]).join(label, "id").join(label.select(F.col("id").alias("start_id"), F.col("label").alias("start")), "start_id")
    verb = literal_map(VERBS)[F.element_at("path", -1)["relation"]]
    how = F.when(F.col("type") == "study", F.format_string(STUDY_OF, "start")).when(F.col("id") != F.col("start_id"), F.format_string(LINKED, "start", "via")).otherwise("")
    ranked = named.select("start_id", "partner", F.size("path").alias("n_edges"), _least(F.col("path")).alias("least"), F.array_join(_ids(F.col("path")), ",").alias("edge_ids"), F.concat(verb, "label", how).alias("why"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("start_id").orderBy("n_edges", F.desc("least"), "partner")))


def first_links(links: DataFrame, most: int) -> DataFrame:
    """links (id, asset, loose, hop) of a disease that can be among the first `most` of a start or tier: (id, asset, loose, worst, hop).

    What is left to compare at one disease doesn't depend on the start: of each asset its best link. Assets that are linked to the same
    one or two diseases are in the same tier of every start, so of these the first `most` of a disease stand for the rest before the starts
    multiply them. Links of an asset of more diseases all stay.
    """
    best = links.groupBy("id", "asset").agg(F.min(F.struct("loose", (-F.col("hop.confidence")).alias("worst"), F.col("hop.id").alias("edge_id"), "hop")).alias("b")).select("id", "asset", "b.*")
    every = Window.partitionBy("asset")
    alike = F.when(F.count("*").over(every) <= 2, F.array(F.min("id").over(every), F.max("id").over(every))).otherwise(F.array("asset"))
    place = F.row_number().over(Window.partitionBy("id", "alike").orderBy("loose", "worst", "asset"))
    return best.withColumn("alike", alike).withColumn("place", place).filter(F.col("place") <= most).select("id", "asset", "loose", "worst", "hop")


def assets(nodes: DataFrame, edges: DataFrame, starts: DataFrame, attributes: DataFrame, most: int = MOST_ASSETS, by_tier: bool = False) -> DataFrame:
    """Studies, publications and assets linked to a start (tier 0), to a disease that shares a gene with it (1) or a mechanism
    of its genes (2): (start_id, tier, rank, asset, near, via, path), the first `most` of a start, or of each tier.

    attributes (id, attributes: a map) says what is known of them. Each asset counts once, by tier, then curated ones
    (with an asset_slug) first, then confidence, length of the path, id and ids of the path.
    """
    reached = walk(nodes, edges, starts, RELATED_EDGES).filter("type = 'disease'")
    shares = F.exists("path", lambda e: e["relation"] == "participates_in")
    tiers = reached.withColumn("tier", F.when(F.size("path") == 0, 0).when(shares, 2).otherwise(1))
    wanted = nodes.filter(F.col("type").isin(*ASSET_TYPES)).select(F.col("id").alias("other_id"))
    loose = attributes.select(F.col("id").alias("other_id"), F.map_contains_key("attributes", F.lit("asset_slug")).alias("slug"))
    ends = incidence(edges).join(reached.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    last = ends.join(wanted, "other_id").join(loose, "other_id", "left").select(F.col("node_id").alias("id"), F.col("other_id").alias("asset"), (~F.coalesce("slug", F.lit(False))).alias("loose"), F.struct(*_HOP).alias("hop"))
    last = saved(first_links(last, most))
    rows = tiers.join(last, "id").select("start_id", "asset", "tier", "loose", F.col("id").alias("near"), "worst", F.concat("path", F.array("hop")).alias("path"))
    # All that tells two paths to one asset apart; what is kept for each start and asset is the least.
    order = ("tier", "loose", "worst", "n", "asset", "ids")
    best = rows.groupBy("start_id", "asset").agg(F.min(F.struct("tier", "loose", "worst", F.size("path").alias("n"), "asset", _ids(F.col("path")).alias("ids"), "near", "path")).alias("b")).select("start_id", "b.*")
    place = Window.partitionBy("start_id", *(["tier"] if by_tier else [])).orderBy(*order)
    first = saved(best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most).select("start_id", "asset", "tier", "rank", "near", "path"))
    return through(first, nodes, ["start_id", "asset"])


def reusable_text(kind: Column, label: Column, known: Column) -> Column:
    """What can be used again: the note that says so, else the design of a study, else the first sentence of what is known."""
    at = lambda name: F.coalesce(F.element_at(known, F.lit(name)), F.lit(""))
    notes = at("curated_notes")
    said = F.get(F.filter(F.split(notes, r"\. "), lambda s: F.startswith(F.lower(F.trim(s)), F.lit("reusable"))), F.lit(0))
    some = lambda name, text: F.when(at(name) != "", text)
    design = F.array_compact(
        F.array(
            F.concat(F.lower(F.coalesce(F.element_at(known, F.lit("study_type")), F.lit("clinical"))), F.lit(" study")),
            some("phase", F.concat(F.lit("phase "), at("phase"))),
            some("status", F.replace(F.lower(at("status")), F.lit("_"), F.lit(" "))),
            some("enrollment", F.concat(at("enrollment"), F.lit(" participants"))),
        )
    )
    line = F.array_join(design, ", ")
    study = F.concat(F.upper(F.substring(line, 1, 1)), F.lower(F.substring(line, F.lit(2), F.length(line))), F.coalesce(some("interventions", F.concat(F.lit("; interventions: "), at("interventions"))), F.lit("")), F.lit(TRANSFER))
    source = F.when(notes != "", notes).otherwise(at("description"))
    other = F.when(source != "", first_sentence(source)).otherwise(F.format_string(UNSAID, label))
    return F.when(said.isNotNull(), first_sentence(said)).when(kind == "study", study).otherwise(other)


def facts_text(known: Column) -> Column:
    """Curated facts to compare by, joined; empty if there are none."""
    at = lambda name: F.nullif(F.element_at(known, F.lit(name)), F.lit(""))
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{label} "), at(name)) for name, label in FACTS.items()])), "; ")


def described(found: DataFrame, nodes: DataFrame, edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """assets() with edge_ids, n_edges, reusable (what can be used again) and differs (what has to be checked first)."""
    label = nodes.select("id", "type", "label").join(attributes.select("id", "attributes"), "id", "left")
    known = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    named = found.join(label.select(F.col("id").alias("asset"), F.col("type").alias("kind"), F.col("label").alias("name"), known.alias("known")), "asset")
    named = named.join(label.select(F.col("id").alias("start_id"), F.col("label").alias("start")), "start_id").join(label.select(F.col("id").alias("near"), F.col("label").alias("near_label")), "near")
    # The start's own curated clinical evidence, first by order of edges, for contrast.
    dosed = label.filter(F.col("type").isin(*ASSET_TYPES) & (F.coalesce(F.element_at("attributes", F.lit("curated_dose")), F.lit("")) != ""))
    at_starts = incidence(edges).join(found.select(F.col("start_id").alias("node_id")).distinct(), "node_id", "left_semi")
    own = at_starts.join(dosed.select(F.col("id").alias("other_id"), F.concat("label", F.lit(" ("), facts_text(F.col("attributes")), F.lit(")")).alias("own")), "other_id")
    own = own.groupBy(F.col("node_id").alias("start_id")).agg(F.min_by("own", F.struct(*_HOP[:4])).alias("own"))
    at = lambda name: F.coalesce(F.element_at("known", F.lit(name)), F.lit(""))
    target = F.coalesce(F.nullif(at("conditions"), F.lit("")), "near_label")
    shared = F.when(F.col("tier") == 1, BY_GENE).otherwise(BY_MECHANISM)
    facts = facts_text(F.col("known"))
    parts = F.array(
        F.when(F.col("tier") == 0, F.format_string(OWN_ASSET, "start")).otherwise(F.format_string(OTHER_ASSET, target, "start", shared, "via", "start")),
        F.when(facts != "", F.format_string(OWN_FACTS, facts)),
        F.when((F.col("tier") > 0) & F.col("own").isNotNull(), F.format_string(CLOSEST, "start", "own")),
        F.when(at("status").isin(*STOPPED_STATUSES), F.format_string(STOPPED, F.lower(at("status")), F.when(at("why_stopped") != "", F.concat(F.lit(": "), at("why_stopped"))).otherwise(""))),
    )
    size = F.when(F.rlike(at("enrollment"), F.lit("^[0-9]+$")), at("enrollment").cast("long")).otherwise(0)
    return named.join(own, "start_id", "left").select(
        "start_id", "tier", "rank", "asset", "kind", "name", "start", "via", "path", F.size("path").alias("n_edges"), F.array_join(_ids(F.col("path")), ",").alias("edge_ids"),
        reusable_text(F.col("kind"), F.col("name"), F.col("known")).alias("reusable"), F.array_join(F.array_compact(parts), "").alias("differs"),
        (~at("status").isin(*OPEN_STATUSES)).alias("closed"), (~F.map_contains_key("known", F.lit("asset_slug"))).alias("loose"), size.cast("long").alias("size"),
    )


def next_steps(told: DataFrame, nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Per start one hypothesis (start_id, text, edge_ids): a study of a related disease, open ones first, then curated, then the
    largest, then by tier and rank; without one the gene that is linked to most diseases; else none.

    told is described().
    """
    cross = told.filter((F.col("n_edges") > 1) & (F.col("kind") == "study"))
    best = cross.groupBy("start_id").agg(F.min_by(F.struct("start", "via", "name", "edge_ids"), F.struct("closed", "loose", -F.col("size"), "tier", "rank")).alias("s"))
    study = F.format_string(TRY_STUDY, "s.start", "s.via", "s.name", "s.start")
    label = nodes.select("id", "label")
    links = incidence(edges.filter(F.col("relation").isin(*BRIDGES[:2])))
    degree = links.groupBy(F.col("node_id").alias("other_id")).agg(F.count("*").alias("n"))
    first = links.join(starts.select(F.col("start_id").alias("node_id")).distinct(), "node_id", "left_semi").join(degree, "other_id").groupBy(F.col("node_id").alias("start_id"))
    genes = first.agg(F.min_by(F.struct(F.col("other_id").alias("gene"), "id"), F.struct(-F.col("n"), "other_id", *_HOP[:4])).alias("g"))
    named = genes.join(label.select(F.col("id").alias("start_id"), F.col("label").alias("start")), "start_id").join(label.select(F.col("id").alias("gene"), F.col("label").alias("name")), F.col("gene") == F.col("g.gene"))
    gene = F.format_string(TRY_GENE, "name", "start", "name")
    studies = best.select("start_id", study.alias("study"), F.col("s.edge_ids").alias("study_ids"))
    both = studies.join(named.select("start_id", gene.alias("gene_text"), F.col("g.id").alias("gene_id")), "start_id", "full")
    return both.select("start_id", F.coalesce("study", "gene_text").alias("text"), F.coalesce("study_ids", "gene_id").alias("edge_ids"))


def bundle(nodes: DataFrame, edges: DataFrame, starts: DataFrame, attributes: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per start one row: numbers of partners and assets, the first of each, the next step, and, where either is missing, the gaps.

    gaps (start_id, missing) is what coverage() finds missing.
    """
    who = partners(nodes, edges, starts).groupBy("start_id").agg(F.count("*").alias("n_partners"), F.min_by("partner", "rank").alias("first_partner"))
    told = saved(described(assets(nodes, edges, starts, attributes), nodes, edges, attributes))
    what = told.groupBy("start_id").agg(F.count("*").alias("n_assets"), F.min_by("asset", "rank").alias("first_asset"), F.max("tier").alias("last_tier"))
    steps = next_steps(told, nodes, edges, starts).withColumnRenamed("edge_ids", "step_ids")
    every = starts.select("start_id").distinct()
    for part in (who, what, steps, gaps):
        every = every.join(part, "start_id", "left")
    n = [F.coalesce(c, F.lit(0).cast("long")) for c in ("n_partners", "n_assets")]
    return every.select("start_id", n[0].alias("n_partners"), "first_partner", n[1].alias("n_assets"), "first_asset", "last_tier", F.col("text").alias("next_step"), "step_ids", F.when((n[0] == 0) | (n[1] == 0), F.col("missing")).alias("missing"))
