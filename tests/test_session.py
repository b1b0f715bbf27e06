"""Scratch folders."""

from __future__ import annotations

import os

from fretwork.session import materialize, scratch_dir, scratch_scope


def test_a_scope_removes_its_own_tables_only(spark):
    outside = materialize(spark.range(3), "outside")
    with scratch_scope(spark) as base:
        inside = materialize(spark.range(5), "inside")
        assert inside.count() == 5 and scratch_dir(spark, "x").startswith(base) and os.path.isdir(base)
    assert not os.path.exists(base)
    assert outside.count() == 3 and not scratch_dir(spark, "y").startswith(base)
