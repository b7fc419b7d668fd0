"""Graph operators against brute force on small random graphs; geometry checks."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from finlake.functions.geodesy import add_latlon
from finlake.operators import geo as G
from finlake.operators import graph as N
from finlake.session import GrowingTable


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, length double")


def _random(seed, n, m):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), float(rnd.randrange(1, 50))) for _ in range(m)]


def _reach(rows):
    nodes = {a for a, _, _ in rows} | {b for _, b, _ in rows}
    out = {}
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            u = todo.pop()
            for a, b, _ in rows:
                if a == u and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[s] = seen
    return out


def _dijkstra(rows, s):
    dist, heap = {}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for a, b, w in rows:
            if a == u and b not in dist:
                heapq.heappush(heap, (d + w, b))
    return dist


# Sparse graphs have many components, so the colouring part runs too.
@pytest.mark.parametrize("seed,n,m", [(1, 25, 30), (2, 30, 40), (3, 12, 40)])
def test_components(spark, seed, n, m):
    rows = _random(seed, n, m)
    reach = _reach(rows)
    want = {u: max(v for v in reach[u] if u in reach[v]) for u in reach}
    labels = N.strong_components(_edges(spark, rows))
    assert {r["id"]: r["component"] for r in labels.collect()} == want
    sizes = {}
    for u, c in want.items():
        sizes.setdefault(c, []).append(u)
    best = min(sizes.values(), key=lambda v: (-len(v), min(v)))
    assert sorted(r["id"] for r in N.largest_scc(_edges(spark, rows)).collect()) == sorted(best)


def _rounds(monkeypatch):
    """Counts the tables written between rounds."""
    seen, checkpoint, write = [], N.materialise, N.stage_table
    monkeypatch.setattr(N, "materialise", lambda df: seen.append(1) or checkpoint(df))
    monkeypatch.setattr(N, "stage_table", lambda df, name: seen.append(1) or write(df, name))
    return seen


# Mutual links fold to the local greatest ids, a third of a shuffled chain each time, so both ways take more rounds.
@pytest.mark.parametrize("shape,n,most", [("one way", 4096, 40), ("circle", 4096, 40), ("both ways", 256, 60)])
def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch, shape, n, most):
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    rows = [(a, b, 1.0) for a, b in zip(ids, ids[1:])]
    if shape == "both ways":
        rows += [(b, a, 1.0) for a, b, _ in rows]
    if shape == "circle":
        rows.append((ids[-1], ids[0], 1.0))
    seen = _rounds(monkeypatch)
    got = N.strong_components(_edges(spark, rows)).groupBy("component").count().orderBy(F.desc("count")).limit(2).collect()
    assert len(seen) <= most
    if shape == "one way":
        assert [r["count"] for r in got] == [1, 1]
    else:
        assert [(r["component"], r["count"]) for r in got] == [(n - 1, n)]


def test_chains_between_and_around_components(spark):
    # Two circles with a chain from one to the other, a chain that leaves and comes back, a mutual pair on it, a tail.
    rows = [(1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 12), (12, 20), (20, 21), (21, 22), (22, 20),
            (1, 30), (30, 31), (31, 99), (99, 31), (31, 32), (32, 1), (22, 40), (40, 41), (41, 42)]
    rows = [(a, b, 1.0) for a, b in rows]
    reach = _reach(rows)
    want = {u: max(v for v in reach[u] if u in reach[v]) for u in reach}
    assert {r["id"]: r["component"] for r in N.strong_components(_edges(spark, rows)).collect()} == want
    assert sorted(r["id"] for r in N.largest_scc(_edges(spark, rows)).collect()) == sorted(u for u in want if want[u] == 99)


def test_three_cycles_and_ties(spark):
    rows = [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0), (5, 6, 1.0), (6, 7, 1.0), (7, 5, 1.0), (2, 3, 1.0), (4, 5, 1.0)]
    labels = {r["id"]: r["component"] for r in N.strong_components(_edges(spark, rows)).collect()}
    assert labels == {1: 2, 2: 2, 3: 4, 4: 4, 5: 7, 6: 7, 7: 7}
    assert not N.is_strongly_connected(_edges(spark, rows)).first()[0]
    tie = _edges(spark, [(9, 8, 1.0), (8, 9, 1.0), (3, 4, 1.0), (4, 3, 1.0), (8, 20, 1.0), (20, 21, 1.0)])
    assert sorted(r["id"] for r in N.largest_scc(tie).collect()) == [3, 4]
    chain = _edges(spark, [(1, 2, 1.0), (2, 3, 1.0)])
    assert [r["id"] for r in N.largest_scc(chain).collect()] == [1]


def test_shortest_paths_matrix_tour_route(spark):
    rows = _random(7, 20, 60) + [(0, 1, 5.0), (0, 1, 2.0)]
    edges, stops = _edges(spark, rows), [0, 3, 5, 3, 11]
    paths = N.shortest_paths(edges, stops)
    got = {(r["source"], r["node"]): (r["dist"], r["pred"]) for r in paths.collect()}
    want = {(s, v): d for s in set(stops) for v, d in _dijkstra(rows, s).items()}
    assert {k: d for k, (d, _) in got.items()} == want
    lengths = {}
    for a, b, w in rows:
        lengths[(a, b)] = min(w, lengths.get((a, b), w))
    for (s, v), (d, p) in got.items():
        assert (p is None) == (s == v)
        if p is not None:
            assert d == got[(s, p)][0] + lengths[(p, v)]

    matrix = N.distance_matrix(paths, stops)
    cells = {(r["source"], r["target"]): r["dist"] for r in matrix.collect()}
    assert cells == {(a, b): want.get((a, b)) for a in set(stops) for b in set(stops) if a != b}

    tour = N.greedy_tour(matrix)
    order = [r["node"] for r in tour.orderBy("seq").collect()]
    walk, at = [0], 0
    while True:
        options = [(cells[(at, t)], t) for t in set(stops) - set(walk) if cells[(at, t)] is not None]
        if not options:
            break
        at = min(options)[1]
        walk.append(at)
    assert order == walk and len(walk) >= 2

    route = N.expand_route(tour, paths)
    nodes = [r["node"] for r in route.orderBy("position").collect()]
    assert [r["position"] for r in route.orderBy("position").collect()] == list(range(len(nodes)))
    assert nodes[0] == walk[0] and nodes[-1] == walk[-1]
    total = sum(lengths[(a, b)] for a, b in zip(nodes, nodes[1:]))
    assert total == pytest.approx(sum(cells[(a, b)] for a, b in zip(walk, walk[1:])))
    s = N.route_summary(route, tour, edges, 10).first()
    assert (s["visited"], s["route_nodes"]) == (len(walk), len(nodes))
    assert s["metres"] == pytest.approx(total) and s["coverage_pct"] == pytest.approx(len(walk) * 10.0)


def _labels(rows, s):
    """(dist, pred) by Bellman-Ford on (dist, roads), ties to the smallest predecessor."""
    best, changed = {s: (0.0, 0, None)}, True
    while changed:
        changed = False
        for a, b, w in rows:
            if a in best and a != b:
                offer = (best[a][0] + w, best[a][1] + 1, a)
                if b not in best or offer[:2] < best[b][:2] or (offer[:2] == best[b][:2] and b != s and a < best[b][2]):
                    best[b], changed = offer, True
    return {v: (d, p) for v, (d, _, p) in best.items()}


@pytest.mark.parametrize("delta", [0.5, 3.0, 7.0, 1000.0, None])
def test_shortest_paths_any_delta(spark, delta):
    rnd = random.Random(5)
    # Short whole lengths, so that many paths tie; roads of length 0 and two nodes out of reach.
    rows = [(rnd.randrange(16), rnd.randrange(16), float(rnd.randrange(0, 6))) for _ in range(50)] + [(30, 31, 1.0)]
    got = {(r["source"], r["node"]): (r["dist"], r["pred"]) for r in N.shortest_paths(_edges(spark, rows), [2, 30], delta).collect()}
    assert got == {(s, v): label for s in (2, 30) for v, label in _labels(rows, s).items()}


def test_shortest_paths_rounds_and_plan(spark, monkeypatch):
    plans, added = [], []
    watched, add = N.watched, GrowingTable.add

    def seen(df, figure):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return watched(df, figure)

    monkeypatch.setattr(N, "watched", seen)
    monkeypatch.setattr(GrowingTable, "add", lambda self, df: (added.append(1), add(self, df)))
    chain = _edges(spark, [(i, i + 1, 1.0) for i in range(12)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = N.shortest_paths(chain, [0], delta=5.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r["node"]: r["dist"] for r in paths.collect()} == {i: float(i) for i in range(13)}
    assert len(added) == 3 and len(plans) == 13 + 3 + 1
    # A round within the last bucket deals its nodes to the roads and the offers to the nodes; final rows and roads stay.
    assert plans[-2].count("Exchange hashpartitioning") == 2 and plans[-2].count("Bucketed: true") == 2
    with pytest.raises(ValueError):
        N.shortest_paths(chain, [0], delta=0.0)
    assert N.shortest_paths(chain, [0], delta=5.0).where("node = 12").first()["pred"] == 11
    assert N.shortest_paths(chain.limit(0), [0]).collect() == [(0, 0, 0.0, None)]


def test_rounds_are_written_as_columns(spark):
    rows, low = N.watched(spark.range(5).select((F.col("id") + 3).alias("node")), F.min("node"))
    assert low == 3 and "FileScan parquet" in rows._jdf.queryExecution().executedPlan().toString()
    assert N.watched(rows.where("node < 0"), F.min("node"))[1] is None


def test_folding_ends_when_it_does_not_pay(spark, monkeypatch):
    rows = _random(4, 150, 700)
    calls, fold = [], N._fold_mutual
    monkeypatch.setattr(N, "_fold_mutual", lambda links: calls.append(1) or fold(links))
    reach = _reach(rows)
    want = {u: max([u, *(v for v in reach[u] if u in reach[v])]) for u in reach}
    assert {r["id"]: r["component"] for r in N.strong_components(_edges(spark, rows)).collect()} == want
    assert len(calls) <= 1


def test_unreachable_and_mutual(spark):
    edges = _edges(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0), (5, 4, 1.0), (4, 6, 1.0), (6, 4, 1.0)])
    matrix = N.distance_matrix(N.shortest_paths(edges, [1, 2, 3, 4, 5, 6]), [1, 2, 3, 4, 5, 6])
    assert {(r["source"], r["target"]) for r in N.unreachable_pairs(matrix).collect()} >= {(3, 1), (1, 4)}
    assert sorted(r["node"] for r in N.mutual_set(matrix).collect()) == [4, 5, 6]
    # Nothing reachable from the first stop: the tour is that stop alone.
    alone = N.greedy_tour(matrix.where("source = 3").withColumn("pos", F.lit(0)))
    assert [r["node"] for r in alone.collect()] == [3]


def _forward(lat, lon):
    """Textbook forward transverse Mercator (Snyder), zone 10, to check the inverse."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon + 123)
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, aa = math.tan(phi) ** 2, ep * math.cos(phi) ** 2, lam * math.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
             + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
    x = k0 * n * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * aa**5 / 120) + 500000
    y = k0 * (m + n * math.tan(phi) * (aa**2 / 2 + (5 - t + 9 * c + 4 * c**2) * aa**4 / 24
              + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * aa**6 / 720))
    return x, y


def test_utm_inverse(spark):
    places = [(49.2827, -123.1207), (49.2, -123.0), (49.31, -122.9), (48.0, -124.5)]
    df = spark.createDataFrame([(*_forward(*p), *p) for p in places], "x double, y double, lat double, lon double")
    out = add_latlon(df, "x", "y", "la", "lo").collect()
    for r in out:
        assert abs(r["la"] - r["lat"]) < 1e-7 and abs(r["lo"] - r["lon"]) < 1e-7


def test_assignment_and_nearest(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (None, 1.0)], "Latitude double, Longitude double")
    centres = [(4, 0.0, 0.0), (2, 1.0, 1.0)]
    assert [r["cluster"] for r in G.assign_cluster(pts, centres).collect()] == [4, 2, 2, None]
    nodes = spark.createDataFrame([(i, 49.0 + i * 0.01, -123.0) for i in range(200)], "id long, lat double, lon double")
    points = [(i, 49.0 + i * 0.013, -123.0) for i in range(120)]
    found = {r["cluster_id"]: r["node_id"] for r in G.nearest_node(nodes, points).collect()}
    assert found == {i: min(range(200), key=lambda j: (abs(lat - (49.0 + j * 0.01)), j)) for i, lat, _ in points}


def test_hotspots(spark):
    rnd = random.Random(3)
    rows = [(49 + c + rnd.random() * 0.01, -123 + c + rnd.random() * 0.01) for c in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "Latitude double, Longitude double")
    centres, points = G.hotspots(df, k=3)
    assert len(centres) == 3 and sorted(r["count"] for r in points.groupBy("cluster").count().collect()) == [40, 40, 40]
