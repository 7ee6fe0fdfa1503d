import random

from larkfield.operators import aggregates, graphs


def test_components_of_lines_stars_and_lone_nodes(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (900, 901)]
    edges += [(rnd.randint(1000, 1200), rnd.randint(1000, 1200)) for _ in range(150)]
    nodes = [1, 2, 7, 3, *range(100, 181)]
    got = {r["n"]: r["component"] for r in graphs.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "n int"), spark.createDataFrame(edges, "a int, b int"), "n", "a", "b").collect()}
    parent = {n: n for n in [*nodes, *[x for a, b in edges if a is not None and a != b for x in (a, b)]]}
    for _ in range(300):
        for a, b in edges:
            if a is not None and a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_totals_of_parts_and_whole(spark):
    stations = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2), (4, "d", 2), (5, "e", 3)], "id int, name string, line int")
    traffic = spark.createDataFrame([("a", 1, 10, 1), ("c", 2, 5, 2)], "name string, line int, total_traffic int, user_count int")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4), (5, 99)], "station1 int, station2 int")
    rows = graphs.network_totals(aggregates.node_stats(stations, traffic, edges), edges).collect()
    got = {r["component"]: tuple(r)[1:] for r in rows}
    assert got == {1: (3, 2, 2, 15, 3, 2, 2), 4: (1, 1, 0, 0, 0, 0, 0), 5: (1, 1, 0, 0, 0, 0, 0), None: (5, 3, 2, 15, 3, 2, 2)}
    assert graphs.network_totals(aggregates.node_stats(stations, traffic, edges).limit(0), edges).count() == 0
