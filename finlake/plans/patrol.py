"""Hotspot and patrol-route queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from finlake.functions.numeric import portable_round
from finlake.operators import geo as G
from finlake.operators import graph as N
from finlake.plans.oracle_views import VIEWS, pr, with_views
from finlake.plans.registry import query
from finlake.plans.tables import crimes, road_edges, road_nodes
from finlake.session import materialise, stage_table


def _utm_sql() -> tuple[str, str]:
    """Latitude and longitude of grid columns gx, gy in SQL.

    Fixed values, own to this check: rectifying radius and third-order series
    coefficients of the inverse projection on the WGS84 ellipsoid, scale and false easting of UTM.
    """
    radius, scale, easting = 6367449.145771048, 0.9996, 500000.0
    beta = (8.377321681862306e-04, 5.9061109218734e-08, 1.676991204140259e-10)
    delta = (3.356551465100355e-03, 6.571913257672216e-06, 1.7677460222466733e-08)
    xi, eta = f"(gy/{scale * radius!r}::DOUBLE)", f"((gx-{easting}::DOUBLE)/{scale * radius!r}::DOUBLE)"
    xc = xi + "".join(f"-({b!r}::DOUBLE)*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, b in enumerate(beta, 1))
    ec = eta + "".join(f"-({b!r}::DOUBLE)*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, b in enumerate(beta, 1))
    chi = f"asin(sin({xc})/cosh({ec}))"
    lat = chi + "".join(f"+({c!r}::DOUBLE)*sin({2 * j}*{chi})" for j, c in enumerate(delta, 1))
    lon = f"{math.radians(-123.0)!r}::DOUBLE+atan2(sinh({ec}),cos({xc}))"
    return f"degrees({lat})", f"degrees({lon})"


_LAT, _LON = _utm_sql()
VIEWS["placed_crimes"] = (("crimes",), f"SELECT *, {_LAT} AS lat, {_LON} AS lon FROM crimes WHERE gx IS NOT NULL AND gy IS NOT NULL")
VIEWS["centres"] = (("placed_crimes",), f"""
SELECT label AS cluster_id, {pr('avg(lat)', 6)} AS lat, {pr('avg(lon)', 6)} AS lon FROM placed_crimes GROUP BY label""")
VIEWS["assigned"] = (("placed_crimes", "centres"), """
SELECT crime_id, (arg_min(cluster_id, (d, cluster_id)))::INTEGER AS cluster FROM (
  SELECT crime_id, cluster_id, (p.lat-c.lat)*(p.lat-c.lat)+(p.lon-c.lon)*(p.lon-c.lon) AS d FROM placed_crimes p, centres c) GROUP BY crime_id""")
_HAV = ("2*6371009e0*asin(least(1e0,sqrt(power(sin(radians(n.lat-c.lat)/2),2)"
        "+cos(radians(c.lat))*cos(radians(n.lat))*power(sin(radians(n.lon-c.lon)/2),2))))")
VIEWS["hotspots"] = (("centres", "nodes"), f"""
SELECT cluster_id, any_value(clat) AS lat, any_value(clon) AS lon, arg_min(id, (d, id)) AS node_id, min(d) AS metres FROM (
  SELECT cluster_id, c.lat AS clat, c.lon AS clon, id, {_HAV} AS d FROM centres c, nodes n) GROUP BY cluster_id""")
VIEWS["stops"] = (("hotspots",), """
SELECT node_id, (row_number() OVER (ORDER BY c)-1)::INTEGER AS pos FROM (SELECT node_id, min(cluster_id) AS c FROM hotspots GROUP BY node_id)""")
# Shortest paths: one row per (source, node), replaced while a better one turns up.
_PATHS = """paths(source, node, dist, pred) USING KEY (source, node) AS (
  SELECT node_id, node_id, 0e0, NULL::BIGINT FROM stops
  UNION SELECT source, node, dist, pred FROM (
    SELECT p.source, r.dst AS node, min(p.dist+r.length) AS dist, arg_min(r.src, (p.dist+r.length, r.src)) AS pred
    FROM paths p JOIN roads r ON p.node=r.src GROUP BY p.source, r.dst) q
  WHERE NOT EXISTS (SELECT 1 FROM recurring.paths b WHERE b.source=q.source AND b.node=q.node AND b.dist<=q.dist))"""
_MATRIX = """matrix AS (SELECT a.pos, a.node_id AS source, b.node_id AS target, p.dist FROM stops a JOIN stops b ON a.node_id<>b.node_id
  LEFT JOIN paths p ON p.source=a.node_id AND p.node=b.node_id)"""
_MUTUAL = """named AS (SELECT s.node_id, s.pos, least(s.pos, min(t.pos)) AS grp FROM stops s
    LEFT JOIN (SELECT m.source, b.pos FROM matrix m JOIN matrix b ON m.source=b.target AND m.target=b.source
      WHERE m.dist IS NOT NULL AND b.dist IS NOT NULL) t ON t.source=s.node_id GROUP BY s.node_id, s.pos),
  mutual AS (SELECT node_id AS node, pos FROM named WHERE grp=(SELECT grp FROM named GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 1))"""
_TOUR = """legs AS (SELECT * FROM matrix WHERE dist IS NOT NULL AND source IN (SELECT node FROM mutual) AND target IN (SELECT node FROM mutual)),
  tour(seq, node, leg, visited) AS (
    SELECT 0, node, NULL::DOUBLE, [node] FROM mutual WHERE pos=(SELECT min(pos) FROM mutual)
    UNION ALL SELECT seq+1, target, dist, list_append(visited, target) FROM (
      SELECT t.seq, t.visited, l.target, l.dist, row_number() OVER (ORDER BY l.dist, l.target) AS rn
      FROM tour t JOIN legs l ON l.source=t.node WHERE NOT list_contains(t.visited, l.target)) WHERE rn=1)"""
_ROUTE = """walk(seq, source, node, back) AS (
    SELECT a.seq, a.node, b.node, 0 FROM tour a JOIN tour b ON b.seq=a.seq+1
    UNION ALL SELECT w.seq, w.source, p.pred, w.back+1 FROM walk w JOIN paths p ON p.source=w.source AND p.node=w.node WHERE p.pred IS NOT NULL),
  route AS (SELECT (row_number() OVER (ORDER BY seq, back DESC)-1)::INTEGER AS position, node FROM (
    SELECT seq, node, back FROM walk WHERE back>0 UNION ALL SELECT max(seq), arg_max(node, seq), 0 FROM tour))"""


def _placed(spark, d):
    raw = crimes(spark, d)
    located = raw.dropna(subset=["X", "Y"]).select("crime_id", "label", F.col("Y").alias("Latitude"), F.col("X").alias("Longitude"))
    return G.utm_to_wgs84(located)


def _centres(spark, d):
    """Mean position per label: as many centres as there are labels."""
    means = _placed(spark, d).groupBy("label").agg(
        portable_round(F.avg("Latitude"), 6).alias("lat"), portable_round(F.avg("Longitude"), 6).alias("lon"))
    return [(r["label"], r["lat"], r["lon"]) for r in means.orderBy("label").collect()]


def _hotspots(spark, d, edges):
    return G.nearest_node(road_nodes(edges), _centres(spark, d))


def _stops(spark, d, edges):
    """Hotspot nodes in cluster order, each once."""
    found = _hotspots(spark, d, edges).orderBy("cluster_id").collect()
    return list(dict.fromkeys(r["node_id"] for r in found))


def _paths(spark, d):
    edges = stage_table(road_edges(spark, d), "edges")
    stops = _stops(spark, d, edges)
    return edges, stops, N.shortest_paths(edges, stops)


def _tour(spark, d):
    edges, stops, paths = _paths(spark, d)
    matrix = materialise(N.distance_matrix(paths, stops))
    keep = N.mutual_set(matrix).select("node")
    inside = matrix.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(
        keep.withColumnRenamed("node", "target"), "target", "left_semi")
    return edges, stops, paths, materialise(N.greedy_tour(inside))


@query("prj4_fil2_fn8_crime_project", with_views(
    """SELECT CASE WHEN d<=day(last_day(make_date(y,m,1))) THEN strftime(make_timestamp(y,m,least(d,day(last_day(make_date(y,m,1)))),h,mi,0),'%Y-%m-%d %H:%M:%S') END AS reported,
    type, gy AS latitude, gx AS longitude, district FROM crimes WHERE gx IS NOT NULL AND gy IS NOT NULL""", "crimes"))
def _(spark, d):
    return G.crime_project(crimes(spark, d)).select(
        F.date_format("ReportedDate", "yyyy-MM-dd HH:mm:ss").alias("reported"), F.col("TYPE").alias("type"),
        F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"), F.col("NEIGHBOURHOOD").alias("district"))


@query("geo1_utm_to_latlon", with_views(
    f"SELECT crime_id, {pr('lat', 8)} AS lat, {pr('lon', 8)} AS lon FROM placed_crimes", "placed_crimes"))
def _(spark, d):
    return _placed(spark, d).select("crime_id", portable_round("Latitude", 8).alias("lat"), portable_round("Longitude", 8).alias("lon"))


@query("geo2_hotspots")
def _(spark, d):
    _, points = G.hotspots(_placed(spark, d))
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("crimes"))


@query("geo2_hotspot_checks", with_views(
    "SELECT count(*) AS points, 0::BIGINT AS misplaced FROM placed_crimes", "placed_crimes"))
def _(spark, d):
    """Every point has one cluster, and no centre is nearer than its own."""
    centres, points = G.hotspots(_placed(spark, d))
    nearest = G.assign_cluster(points.withColumnRenamed("cluster", "own"), centres)
    return nearest.agg(F.count("*").alias("points"), F.count_if(F.col("cluster") != F.col("own")).alias("misplaced"))


@query("geo3_assign_cluster", with_views("SELECT * FROM assigned", "assigned"))
def _(spark, d):
    return G.assign_cluster(_placed(spark, d), _centres(spark, d)).select("crime_id", "cluster")


@query("geo4_joi5_nearest_node", with_views(f"SELECT cluster_id, lat, lon, node_id, {pr('metres', 4)} AS metres FROM hotspots", "hotspots"))
def _(spark, d):
    return _hotspots(spark, d, road_edges(spark, d)).withColumn("metres", portable_round("metres", 4))


@query("geo5_centroid", with_views(f"SELECT {pr('avg(lat)', 7)} AS lat, {pr('avg(lon)', 7)} AS lon FROM placed_crimes", "placed_crimes"))
def _(spark, d):
    return G.centroid(_placed(spark, d)).select(portable_round("lat", 7).alias("lat"), portable_round("lon", 7).alias("lon"))


@query("geo6_hotspot_table", with_views(
    """SELECT h.cluster_id, node_id, lat, lon, coalesce(n, 0) AS crimes, CASE WHEN node_id IN (SELECT node FROM tour) THEN 'Included' ELSE 'Excluded' END AS status
    FROM hotspots h LEFT JOIN (SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster) a ON a.cluster=h.cluster_id""",
    "assigned", "stops", "roads", recursive=f"{_PATHS}, {_MATRIX}, {_MUTUAL}, {_TOUR}"))
def _(spark, d):
    edges, _, _, tour = _tour(spark, d)
    assigned = G.assign_cluster(_placed(spark, d), _centres(spark, d))
    return G.hotspot_table(assigned, _hotspots(spark, d, edges), tour)


@query("gra1_strong_components", with_views(
    """SELECT n.id, coalesce(greatest(max(f.b), n.id), n.id) AS component FROM nodes n
    LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a=y.b AND x.b=y.a) f ON f.a=n.id GROUP BY n.id""",
    "roads", "nodes", recursive="reach(a, b) AS (SELECT src, dst FROM roads UNION SELECT r.a, e.dst FROM reach r JOIN roads e ON r.b=e.src)"))
def _(spark, d):
    return N.strong_components(stage_table(road_edges(spark, d), "edges"))


@query("gra1_largest_scc", with_views(
    """SELECT id FROM comp WHERE component=(SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, min(id) LIMIT 1)""",
    "roads", "nodes", recursive="""reach(a, b) AS (SELECT src, dst FROM roads UNION SELECT r.a, e.dst FROM reach r JOIN roads e ON r.b=e.src),
    comp AS (SELECT n.id, coalesce(greatest(max(f.b), n.id), n.id) AS component FROM nodes n
      LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a=y.b AND x.b=y.a) f ON f.a=n.id GROUP BY n.id)"""))
def _(spark, d):
    return N.largest_scc(stage_table(road_edges(spark, d), "edges"))


@query("gra2_shortest_paths", with_views(
    f"SELECT source, node, {pr('dist', 6)} AS dist, pred FROM paths", "stops", "roads", recursive=_PATHS))
def _(spark, d):
    return _paths(spark, d)[2].withColumn("dist", portable_round("dist", 6))


@query("gra3_distance_matrix", with_views(
    f"SELECT pos, source, target, {pr('dist', 6)} AS dist FROM matrix", "stops", "roads", recursive=f"{_PATHS}, {_MATRIX}"))
def _(spark, d):
    _, stops, paths = _paths(spark, d)
    return N.distance_matrix(paths, stops).withColumn("dist", portable_round("dist", 6))


@query("gra4_mutual_set", with_views("SELECT * FROM mutual", "stops", "roads", recursive=f"{_PATHS}, {_MATRIX}, {_MUTUAL}"))
def _(spark, d):
    _, stops, paths = _paths(spark, d)
    return N.mutual_set(N.distance_matrix(paths, stops))


@query("gra5_udf6_greedy_tour", with_views(
    f"SELECT seq, node, {pr('leg', 6)} AS leg FROM tour", "stops", "roads", recursive=f"{_PATHS}, {_MATRIX}, {_MUTUAL}, {_TOUR}"))
def _(spark, d):
    return _tour(spark, d)[3].select("seq", "node", portable_round("leg", 6).alias("leg"))


@query("gra6_expand_route", with_views(
    "SELECT * FROM route", "stops", "roads", recursive=f"{_PATHS}, {_MATRIX}, {_MUTUAL}, {_TOUR}, {_ROUTE}"))
def _(spark, d):
    _, _, paths, tour = _tour(spark, d)
    return N.expand_route(tour, paths).select("position", "node")


@query("gra7_route_summary", with_views(
    f"""SELECT (SELECT count(*) FROM tour) AS visited, (SELECT count(*) FROM route) AS route_nodes, {pr('m', 4)} AS metres,
    {pr('(SELECT count(*) FROM tour)*100e0/(SELECT count(*) FROM centres)')} AS coverage_pct, {pr('m/1000/(SELECT count(*) FROM tour)', 6)} AS km_per_hotspot
    FROM (SELECT coalesce(sum(length::DECIMAL(28,6))::DOUBLE,0e0) AS m FROM route a JOIN route b ON b.position=a.position+1 JOIN roads ON src=a.node AND dst=b.node)""",
    "stops", "roads", "centres", recursive=f"{_PATHS}, {_MATRIX}, {_MUTUAL}, {_TOUR}, {_ROUTE}"))
def _(spark, d):
    edges, _, paths, tour = _tour(spark, d)
    out = N.route_summary(materialise(N.expand_route(tour, paths)), tour, edges, len(_centres(spark, d)))
    return out.select("visited", "route_nodes", portable_round("metres", 4).alias("metres"),
                      portable_round("coverage_pct").alias("coverage_pct"), portable_round("km_per_hotspot", 6).alias("km_per_hotspot"))
