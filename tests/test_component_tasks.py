"""Components settled in one task and by rounds over all edges."""

from facetry.operators import components


def test_components_in_a_task_are_those_of_rounds(spark, monkeypatch):
    """A long path, a star and random edges; a group of few edges must not start a round."""
    rows = [(0, i, i + 1) for i in range(60)] + [(1, 100, 5 * i) for i in range(20)] + [(2, i * 7919 % 97, i * 104729 % 89) for i in range(80)]
    edges = spark.createDataFrame(rows, "g bigint, a bigint, b bigint")
    got = [sorted(tuple(r) for r in components.connected_components(edges, ["g"], n).select("g", "node", "root").collect()) for n in (100, 50, 0)]
    assert got[0] == got[1] == got[2] and {r for r in got[0] if r[0] == 0} == {(0, i, 0) for i in range(61)}
    monkeypatch.setattr(components, "_contracted", None)
    assert sorted(tuple(r) for r in components.connected_components(edges, ["g"]).select("g", "node", "root").collect()) == got[0]
