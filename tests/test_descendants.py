"""The contents of the descendants' intervals over whole tables against SQL that walks down the links."""

from __future__ import annotations

import pytest

import __spark_entry__
from elemlake.plans.problem_queries import _P6_PATHS
from tests.oracle import DATA, duck


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_intervals_hold_the_descendants(spark, sf):
    con = duck(sf)
    found = __spark_entry__.queries()["p6_descendants"](spark, f"{DATA}/{sf}").toPandas()
    con.register("found", found)
    inside = "select x.ref0 || '/' || x.ref1 as a, y.ref0 || '/' || y.ref1 as d from found x join found y on y.root_ref0 = x.root_ref0 and y.root_ref1 = x.root_ref1 and y.preorder > x.preorder and y.preorder <= x.last_descendant"
    walked = _P6_PATHS[: _P6_PATHS.index("below as (")].rstrip().rstrip(",") + " select unnest(path[:-2]) as a, ref0 || '/' || ref1 as d from down"
    con.execute(f"create table walked as {walked}")
    con.execute(f"create table inside as {inside}")
    assert con.execute("select count(*) from walked").fetchone()[0] > 100
    assert con.execute("select count(*) from (from walked except all from inside)").fetchone() == con.execute("select count(*) from (from inside except all from walked)").fetchone() == (0,)
