"""Schemas and vocabulary of the evidence graph."""

from __future__ import annotations

#: Node types, relations and kinds of evidence.
NODE_TYPES = ("disease", "gene", "variant", "mechanism", "phenotype", "patient_group", "publication", "study", "asset", "investigator", "funder")
RELATIONS = (
    "caused_by", "risk_factor_for", "has_variant", "variant_associated_with", "has_mechanism", "participates_in", "has_phenotype",
    "shares_mechanism_with", "similar_phenotype_to", "mentions", "claims", "authored_by", "studies_condition", "tests_intervention",
    "investigates", "funds", "works_on", "represents", "operates", "contradicts",
)
EVIDENCE_TYPES = ("observed", "inferred", "curated")

#: Cost floor and penalties of routing, trust bonuses and limits, floors of similarity and its weights.
LEAST_CONFIDENCE, INFERRED_COST, HUB_COST = 0.01, 1.0, 1.5
BONUS_STEP, BONUS_MOST, DISPUTE_COST = 0.05, 0.15, 0.15
SCORE_LEAST, SCORE_MOST, INFERRED_MOST = 0.05, 0.99, 0.49
STRONG, LOW = 0.4, 0.7
IC_FLOOR, PHENOTYPE_WEIGHT, GENE_WEIGHT, MECHANISM_WEIGHT = 2.5, 0.5, 0.3, 0.2
