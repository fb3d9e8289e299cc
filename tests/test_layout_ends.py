from farglass.operators import layout
from farglass.runtime import materialise


def test_places_of_many_points_are_not_broadcast(spark):
    """A round broadcast all places twice, so they passed the driver in every round."""
    n = layout.BROADCAST_POINTS
    edges = materialise(spark.range(50).selectExpr("id as own", "id * 7 % 50 as other", "1.0D as w"), "edges")
    x = materialise(spark.range(50).selectExpr("id", "array(double(id), -double(id)) as x"), "places")
    few, many = layout._ends(edges, x, n), layout._ends(edges, x, n + 1)
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    plain = lambda t: sorted((r.own, r.other, r.w, tuple(r.x), tuple(r.y)) for r in t.collect())
    assert plain(many) == plain(few) == sorted((i, i * 7 % 50, 1.0, (i, -i), (i * 7 % 50, -(i * 7 % 50))) for i in range(50))
