"""Probes answered from the index equal those of a scan."""

import numpy as np
import pytest

from statcube.operators import filters
from statcube.operators.probe_index import ProbeIndex, probe_conditions
from tests.test_plans import plan_text
from tests.test_properties import random_cube

SPECS = [("T", ["A"], ["B"], {}), ("T", ["A"], [], {"B": ["x", "z"]}), ("T", ["C"], [], {"A": ["a"], "B": ["x", "none"]}), ("T", ["B"], [], {"T": ["2021", 2022], "A": ["a", "b"]}),
         ("T", ["C"], [], {"A": ["a", "b", "c"], "B": ["x", "y", "z"]}), ("A", ["B"], [], {"C": []}), ("T", ["A"], [], {"A": ["a"], "C": ["q"]}), (None, ["A"], ["C"], {"B": ["y"]})]


@pytest.mark.parametrize("seed", range(6))
def test_flags_equal_the_scan(spark, seed):
    cube, _ = random_cube(spark, seed)
    cube = cube.cache()
    index = ProbeIndex.of(cube)
    for probe in ("prefix", "full"):
        plans = [filters.probe_plan(cube, t, r, c, f, probe)[1] for t, r, c, f in SPECS]
        asked = [probe_conditions(cube, t, r, c, f, probe) for t, r, c, f in SPECS]
        assert [[d for d, _ in a] for a in asked] == [[d for d, _ in p] for p in plans]
        assert index.flags(asked) == filters.subtotal_flags_many(cube, plans)
    cube.unpersist()


def test_index_is_small_and_answers_without_the_cube(spark):
    import __spark_entry__ as E

    cube = E.oc.decoded_cube(spark, "/root/testdata/sf0.001", materialize=True)
    index = ProbeIndex.of(cube)
    assert index.rows.count() < 0.2 * cube.count()
    index._look_up = None  # one filter at a time needs no look-up
    for f in ({}, {"SEG": ["BUILDING"]}, {"DATA_YR": ["1996"]}):
        flags = index.flags([probe_conditions(cube, "DATA_YR", ["COUNTY"], [], f)])[0]
        assert flags == filters.subtotal_flags(cube, filters.probe_plan(cube, "DATA_YR", ["COUNTY"], [], f)[1])
    text = plan_text(E.queries()["smart_filter_indexed"](spark, "/root/testdata/sf0.001"))
    assert "IsNull(PRI)" in text and "Subquer" not in text


def test_two_narrow_filters_are_looked_up_in_their_sets(spark):
    rows = [(1, "a", "x", None, 1), (1, "b", "y", None, 1), (1, "a", "y", "p", 1)]
    cube = spark.createDataFrame(rows, "T long, A string, B string, C string, CNT long")
    index, asked = ProbeIndex.of(cube), []
    for a, b in (("a", "x"), ("a", "y"), ("b", "y"), ("b", "q")):
        asked.append(probe_conditions(cube, "T", ["A"], ["B"], {"A": [a], "B": [b]}))
    assert [f[0] for f in index.flags(asked)] == [True, False, True, False]
