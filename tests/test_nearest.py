"""Nearest vectors against plain sorting, in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from skein.operators import resolver, search


def _unit(x):
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _batches(ids, vectors, name, size):
    return (pd.DataFrame({name: ids[i : i + size], "embedding": list(vectors[i : i + size])}) for i in range(0, len(ids), size))


@pytest.mark.parametrize("held", [1, 3000, 4 << 20])
def test_nearest_equals_sorting_all(monkeypatch, held):
    monkeypatch.setattr(search, "SCORE_BYTES", held)
    r = np.random.default_rng(5)
    # Few different vectors, so that many scores are equal; one has no finite length.
    v = _unit(np.round(r.normal(size=(40, 4))) + 0.1)[r.integers(0, 40, 200)]
    v[7] = np.inf
    ids, asked = r.permutation(200).astype(np.int64), np.arange(0, 200, 20)
    q = np.nan_to_num(np.array([v[np.where(ids == i)[0][0]] for i in asked]), posinf=0.1)
    with np.errstate(invalid="ignore"):
        found = search.nearest_of(asked, q, _batches(ids, v, "vec_id", 60), 6)
        near = resolver.nearest_of([f"m{i}" for i in asked], q, _batches(np.array([f"n{i // 3:02}" for i in ids], object), v, "id", 60), 6)
    for k, a in enumerate(asked):
        scores = {int(i): int(np.floor(q[k] @ x * 10000 + 0.5)) for i, x in zip(ids, v, strict=True) if np.isfinite(x).all()}
        expected = sorted((-s, i) for i, s in scores.items() if i != a)[:6]
        assert sorted((-s, i) for x, i, s in found.itertuples(index=False) if x == a) == expected
        best: dict = {}
        for i, s in scores.items():
            best[f"n{i // 3:02}"] = max(best.get(f"n{i // 3:02}", s), s)
        assert sorted((-s, i) for x, i, s in near.itertuples(index=False) if x == f"m{a}") == sorted((-s, i) for i, s in best.items())[:6]


@pytest.mark.parametrize("of_nodes", [False, True])
def test_a_full_batch_and_block_take_little_memory(of_nodes):
    r = np.random.default_rng(1)
    v = _unit(r.normal(size=(10000, 16)))
    tracemalloc.start()
    if of_nodes:
        found = resolver.nearest_of([str(i) for i in range(2000)], v[:2000], _batches(np.array([f"n{i // 2}" for i in range(10000)], object), v, "id", 10000), 6)
    else:
        found = search.nearest_of(np.arange(2000), v[:2000], _batches(np.arange(10000), v, "vec_id", 10000), 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 12000
    assert peak < 100 << 20
