"""Long texts in bounded memory: passages in pieces, scores of long bags, blocks of test items by bytes."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, pii, quality_model


def test_passages_do_not_depend_on_pieces():
    deal = random.Random(3)
    for _ in range(60):
        text = "".join(deal.choice("ab.,! \n\té9#") if deal.random() < 0.8 else " " for _ in range(deal.choice((0, 1, 2, 5, 50, 2000)))).encode()
        whole = quality_model.passages(text)
        words = len(text.replace(b"\t", b" ").replace(b"\n", b" ").split())
        assert len(whole) == max(1, -(-words // quality_model.PASSAGE_WORDS))
        for size in (1, 2, 7, 64, 777):
            if size > 2 or len(text) < 100:
                assert np.array_equal(np.concatenate(list(quality_model.pieces(text, size))), whole)
    assert np.array_equal(quality_model.passages(None), quality_model.passages(b""))


def test_passages_of_plain_words():
    """Counts of a small text by hand: pairs of kinds, number of words, characters a word."""
    row = quality_model.passages(b"ab A.")[0]
    pairs = row[: quality_model.KINDS**2].reshape(quality_model.KINDS, -1)
    assert {(int(i), int(j)) for i, j in np.argwhere(pairs)} == {(0, 0), (0, 3), (3, 1), (1, 5)} and np.allclose(pairs[pairs > 0], 0.5)
    assert np.isclose(row[-2], np.log1p(2) / 5) and np.isclose(row[-1], 4 / 2 / 20)


@pytest.mark.parametrize("text", [b"Some words, and. more\n" * 20_000, b"x" * 400_000, b" " * 400_000])
def test_scores_of_long_bags_and_their_memory(text):
    model = quality_model.AttentionModel.new(1)
    score, n = model.score_long(quality_model.pieces(text, 1 << 12))
    whole = quality_model.passages(text)
    assert n == len(whole) and np.isclose(score, model.score([whole])[0], atol=1e-12)

    def peak(times: int) -> int:
        tracemalloc.start()
        model.score_long(quality_model.pieces(text[: len(text) // 4] * times, 1 << 12))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most - len(text) // 4 * times

    assert peak(4) < 1.3 * peak(1) + 100_000


def test_long_texts_score_as_short_ones_do(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("Good prose, well kept. " if i % 2 else "## | || $$ ") * (i + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    expected = {r.doc_id: (r.score, r.predicted, r.n_passages) for r in quality_model.score_quality(docs, labels, F.col("doc_id") < 30).collect()}
    monkeypatch.setattr(quality_model, "PIECE", 100)
    found = {r.doc_id: (r.score, r.predicted, r.n_passages) for r in quality_model.score_quality(docs, labels, F.col("doc_id") < 30).collect()}
    assert found.keys() == expected.keys() and all(np.isclose(found[k][0], expected[k][0], atol=1e-9) and found[k][1:] == expected[k][1:] for k in found)


def test_blocks_by_items_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    texts = ["a" * 8, "b" * 8, "c" * 8, "d" * 50, None, "", "e", "f", "g" * 20]
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item_id string, text string").selectExpr("item_id", "cast(text AS binary) AS text").coalesce(1)
    blocks = list(decontaminate._blocks(items))
    assert [[i for i, _ in b] for b, _ in blocks] == [["0", "1"], ["2"], ["3"], ["4", "5", "6"], ["7"], ["8"]]
    assert [last for _, last in blocks] == [False] * 5 + [True] and list(decontaminate._blocks(items.limit(0))) == []


def test_segments_do_not_depend_on_strides(monkeypatch):
    texts = [" ".join(t for t, _ in pii.generated(k, k)) for k in (1, 3, 9, 30)] + ["", "a", "12345"]
    fields = [pii.SegmentField().fit(pii.generated(100, 5)), *[pii.SegmentField(np.random.default_rng(i).normal(0, 1, (4, pii.FEATURES + 5))) for i in range(3)]]
    expected = [f.best(t) for f in fields for t in texts]
    assert sum(map(len, expected)) > 100
    for stride in (1, 2, 17, pii.LONGEST + 1):
        monkeypatch.setattr(pii, "STRIDE", stride)
        assert [f.best(t) for f in fields for t in texts] == expected


def test_long_runs_of_numbers_take_linear_memory_and_time():
    field = pii.SegmentField().fit(pii.generated(100, 5))
    numbers = " ".join(map(str, np.random.default_rng(1).integers(0, 10**7, 16_000)))

    def peak(text: str) -> int:
        tracemalloc.start()
        field.best(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(numbers) - peak(numbers[: len(numbers) // 4]) < 40 * len(numbers)
