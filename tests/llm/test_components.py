"""When the rounds of connected components end."""

from listwright.llm import components as C


def test_rounds_end_once_all_edges_are_stars(spark, monkeypatch):
    edges = lambda *e: spark.createDataFrame(e, "u long, v long")
    assert C._stars(edges((2, 1), (3, 1), (9, 8)))
    assert not C._stars(edges((2, 1), (3, 2))) and not C._stars(edges((3, 1), (3, 2)))
    seen = []
    state = C._state
    monkeypatch.setattr(C, "_state", lambda e: seen.append(1) or state(e))
    got = C.connected_components(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")).collect()
    assert {(r.id, r.component) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert len(seen) == 2  # one round, and none to see that nothing changes
