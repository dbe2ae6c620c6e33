from __future__ import annotations

import os

from skein.operators.work import saved, settled, work_root


def test_settled_keeps_only_the_result(spark):
    root, before = work_root(spark), set(os.listdir(work_root(spark)))

    def make():
        one = saved(spark.range(5))
        return settled(spark, lambda: saved(one).filter("id > 1")).filter("id > 2")

    out = settled(spark, make)
    assert sorted(r["id"] for r in out.collect()) == [3, 4]
    assert len(set(os.listdir(root)) - before) == 1
