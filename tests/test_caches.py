"""Keys as Python hashes them, and upserts of a cache held against a dictionary."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from skein.operators import caches

TEXTS = ["plain", "", " ", 'a"b\\c/', "l\nm\r\t\b\f\x01\x7f\x1f", "é– x", "\U0001f600퟿", "ends\n", "'~}"]


def test_keys_are_python_json(spark):
    df = spark.createDataFrame([(t, ["z", t, "aé"]) for t in TEXTS], "t string, ids array<string>")
    got = df.select("t", "ids", caches.python_json(F.col("t")).alias("j"), caches.decision_key(F.lit("m"), F.col("t"), F.col("ids")).alias("d"), caches.claims_key(F.lit("m"), F.col("t"), F.lit("v")).alias("c")).collect()
    for r in got:
        assert r.j == json.dumps(r.t)
        assert r.d == hashlib.sha256(json.dumps(["m", caches.DECISION_PROMPT, r.t, sorted(r.ids)]).encode()).hexdigest()
        assert r.c == hashlib.sha256(json.dumps(["m", caches.CLAIM_PROMPT, r.t, "v"]).encode()).hexdigest()
    one = caches.with_embedding_key(spark.createDataFrame([("Type II  βeta-x",)], "t string"), F.lit("m"), F.col("t")).first()
    assert one.key == hashlib.sha256(b"m\ntype 2 beta eta x").hexdigest()


def _at(day):
    return dt.datetime(2025, 1, day)


def test_upserts_equal_a_dictionary(spark, tmp_path):
    path, held, deal = str(tmp_path / "cache"), {}, random.Random(5)
    for _ in range(3):
        batch = [(f"{deal.randrange(16):x}{deal.randrange(4)}", json.dumps({"n": deal.randrange(3)}), _at(deal.randrange(1, 9))) for _ in range(30)]
        for k, b, t in batch:
            held[k] = max(held.get(k, (t, b)), (t, b))
        caches.upsert(path, spark.createDataFrame([*batch, (None, "{}", _at(1)), ("ff", None, _at(30))], caches.ROWS), digits=1)
        assert {r.key: (r.made_at, r.body) for r in caches.load(spark, path).collect()} == held


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a1", "1", _at(1)), ("a2", "2", _at(1)), ("b1", "3", _at(1))], caches.ROWS)
    assert caches.load(spark, path).count() == 0
    assert caches.upsert(path, rows, 1) == 2
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    assert caches.upsert(path, rows, 1) == 0 and caches.upsert(path, rows.limit(0), 1) == 0
    assert caches.upsert(path, spark.createDataFrame([("a2", "0", _at(1)), ("a1", "9", dt.datetime(2024, 1, 1))], caches.ROWS), 1) == 0
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")} == before
    assert caches.upsert(path, spark.createDataFrame([("a3", "4", _at(2)), ("a1", "5", _at(2))], caches.ROWS), 1) == 1
    after = glob.glob(f"{path}/*/*.parquet")
    assert [f for f in after if "=b" in f] == [f for f in before if "=b" in f] and not set(f for f in before if "=a" in f) & set(after)
    assert {(r.key, r.body) for r in caches.load(spark, path).collect()} == {("a1", "5"), ("a2", "2"), ("a3", "4"), ("b1", "3")}


def test_malformed_entries_are_ignored_and_missing_texts_asked_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    bodies = ['{"node_id":"n","model":"m"}', '{"node_id":', "[]", "7", '{"model":"m"}', '{"node_id":null,"model":"m"}', '{"node_id":"x","model":"m","more":1}']
    caches.upsert(path, spark.createDataFrame([(f"{i:02d}", b, _at(1)) for i, b in enumerate(bodies)], caches.ROWS), 1)
    assert {r.node_id for r in caches.load(spark, path, "node_id string, model string", ("node_id", "model")).collect()} == {"n", "x"}
    assert caches.load(spark, path, "node_id string, model string").count() == 4
    asked = spark.createDataFrame([("00", "known", 0), ("77", "second", 2), ("77", "first", 1), ("78", "  ", 3)], "key string, text string, pos int")
    assert [(r.key, r.text) for r in caches.missing(asked, caches.load(spark, path)).collect()] == [("77", "first")]
