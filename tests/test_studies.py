"""Nested records of studies, read by the leaves that are used."""

from __future__ import annotations

import json

from skein.sources import studies

FULL = {
    "protocolSection": {
        "identificationModule": {"nctId": "NCT1", "briefTitle": " A\n study ", "acronym": "AS", "orgStudyIdInfo": {"id": "x"}}, "statusModule": {"overallStatus": "RECRUITING", "whyStopped": "", "startDateStruct": {"date": "2024-01", "type": "ACTUAL"}},
        "designModule": {"phases": ["PHASE1", "PHASE2"], "studyType": "INTERVENTIONAL", "enrollmentInfo": {"count": 12, "type": "ESTIMATED"}}, "conditionsModule": {"conditions": ["c", "d"]},
        "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "n", "otherNames": ["q"]}, {"type": "DRUG", "name": None}, {"name": "m"}]}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "S", "class": "NIH"}},
        "descriptionModule": {"briefSummary": "word " * 200}, "eligibilityModule": {"sex": "ALL"},
    },
    "hasResults": True, "derivedSection": {"big": "unread"},
}


def test_records_with_much_little_and_nothing(spark, tmp_path):
    few = {"protocolSection": {"identificationModule": {"nctId": "NCT2"}}}
    (tmp_path / "s.json").write_text("\n".join([json.dumps(FULL), json.dumps(few), "{broken", "{}", json.dumps({"protocolSection": None})]))
    found = studies.read(spark, str(tmp_path))
    rows = {r.id: r for r in studies.nodes(found).collect()}
    assert set(rows) == {"clinicaltrials:NCT1", "clinicaltrials:NCT2"}
    one, two = rows["clinicaltrials:NCT1"], rows["clinicaltrials:NCT2"]
    assert (one.label, one.synonyms) == ("A study", ["AS", "NCT1"]) and (two.label, two.synonyms) == ("NCT2", ["NCT2"])
    summary = one.attributes.pop("description")
    assert summary.endswith("word...") and len(summary) <= studies.SUMMARY_MOST + 3
    assert one.attributes == {
        "acronym": "AS", "conditions": "c; d", "enrollment": "12", "enrollment_type": "ESTIMATED", "has_results": "true", "intervention_types": "DRUG", "interventions": "n; m", "nct_id": "NCT1",
        "phase": "1/2", "sponsor": "S", "start_date": "2024-01", "status": "RECRUITING", "study_type": "INTERVENTIONAL", "url": "https://clinicaltrials.gov/study/NCT1",
    }
    assert two.attributes == {"has_results": "false", "nct_id": "NCT2", "url": "https://clinicaltrials.gov/study/NCT2"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "eligibilityModule" not in plan and "derivedSection" not in plan and "otherNames" not in plan


def test_an_id_alone_reads_one_leaf(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(FULL))
    plan = studies.read(spark, str(tmp_path)).select("nct_id")._jdf.queryExecution().executedPlan().toString()
    assert "nctId" in plan and "briefSummary" not in plan.split("ReadSchema")[1] and studies.read(spark, str(tmp_path)).count() == 1


def test_other_columns_stay_and_queries_are_told(spark):
    records = spark.createDataFrame([(None, None, ["a", "b"])], studies.RECORD + ", matched_queries array<string>")
    flat = studies.flat(records)
    assert flat.first().matched_queries == ["a", "b"] and flat.first().phases == [] and studies.nodes(flat).count() == 0
    told = flat.withColumn("nct_id", flat.nct_id.isNull().cast("string"))
    assert studies.nodes(told).first().attributes["matched_queries"] == "a,b"
