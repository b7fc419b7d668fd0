"""Road graph: strong components, shortest paths, patrol tours.

The iterative operators are frontier joins. Each round cuts its lineage with a
reliable checkpoint and stops when nothing changed; only row counts reach the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.operators.skew import attach
from finlake.session import bucketed, growing, stage_table, watched
from finlake.session import written as materialise

# Rounds after which the union of deltas is rewritten as one table.
CONSOLIDATE = 10
# A round costs more than repeated relaxations: buckets of so many times the longest road.
ROADS_IN_BUCKET = 2


def min_edges(edges: DataFrame) -> DataFrame:
    """Shortest of parallel edges, loops dropped."""
    return edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.min("length").alias("length"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """Ids reachable from ``start`` (id) over ``links`` (src, dst), start included."""
    frontier = start.select("id")
    seen = [frontier]
    with bucketed(links, "src") as table:
        while True:
            step = frontier.join(table, frontier["id"] == table["src"]).select(F.col("dst").alias("id")).distinct()
            frontier = materialise(step.join(_union(seen), "id", "left_anti"))
            if frontier.isEmpty():
                return _union(seen)
            seen.append(frontier)
            if len(seen) > CONSOLIDATE:
                seen = [materialise(_union(seen))]


def _within(links: DataFrame, ids: DataFrame) -> DataFrame:
    keep = ids.select("id")
    return links.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _peel(links: DataFrame, degrees: DataFrame) -> DataFrame:
    """Drop links that end in nodes without in- or out-links: no cycle passes through them."""
    return _within(links, degrees.where((F.col("ins") > 0) & (F.col("outs") > 0)))


def _degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        links.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


def _jump(steps: DataFrame) -> DataFrame:
    """Follow pointers (id, way, at, open) to their ends by doubling them.

    ``open`` says that another pointer of the same way begins at ``at``. After
    round k a pointer spans 2^k steps, so those still open after log2 of their
    number run in circles and stay so. Only open pointers are joined: in a
    chain they end in different nodes, so no key is hot. ``top`` is the
    greatest id passed.
    """
    steps = materialise(steps.withColumn("top", F.greatest("id", "at")))
    size, span = steps.count(), 1
    while span <= size and not steps.where("open").isEmpty():
        ahead = steps.select(F.col("id").alias("at"), "way", F.col("at").alias("to"), F.col("open").alias("more"),
                             F.col("top").alias("high"))
        moved = steps.where("open").join(ahead, ["at", "way"]).select(
            "id", "way", F.col("to").alias("at"), F.col("more").alias("open"), F.greatest("top", "high").alias("top"))
        steps = materialise(steps.where("NOT open").unionByName(moved))
        span *= 2
    return steps


def _fold_mutual(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join nodes that link to each other: (links between the joined nodes, folds).

    Each node points to the greatest of its mutual neighbours above it; what
    hangs together by these pointers is one node from now on.
    """
    pairs = links.groupBy(F.least("src", "dst").alias("id"), F.greatest("src", "dst").alias("at")).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") == 2)
    up = materialise(pairs.groupBy("id").agg(F.max("at").alias("at")))
    if up.isEmpty():
        return links, up.select("id", F.col("at").alias("head"), F.col("at").alias("tail"))
    known = up.select(F.col("id").alias("at"), F.lit(True).alias("open"))
    up = _jump(attach(up.withColumn("way", F.lit(0)), known, ["at"], "left").withColumn(
        "open", F.coalesce("open", F.lit(False))))
    ends = links
    for end in ("src", "dst"):
        ends = attach(ends, up.select(F.col("id").alias(end), F.col("at").alias("_at")), [end], "left").withColumn(
            end, F.coalesce("_at", end)).drop("_at")
    ends = ends.where(F.col("src") != F.col("dst")).distinct()
    return stage_table(ends, "links"), up.select("id", F.col("at").alias("head"), F.col("at").alias("tail"))


def _fold_chains(links: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace each chain of nodes with one link in and one out by a link between its ends: (links, folds).

    A circle of such nodes is a component of its own and folds into its greatest id.
    """
    inner = materialise(degrees.where((F.col("ins") == 1) & (F.col("outs") == 1)).select("id"))
    if inner.isEmpty():
        return links, inner.select("id", F.col("id").alias("head"), F.col("id").alias("tail"))
    known = inner.withColumn("open", F.lit(True))
    at = known.withColumnRenamed("id", "at")
    ways = links.select(F.col("src").alias("id"), F.lit(1).alias("way"), F.col("dst").alias("at")).unionByName(
        links.select(F.col("dst").alias("id"), F.lit(-1).alias("way"), F.col("src").alias("at")))
    steps = attach(ways.join(inner, "id", "left_semi"), at, ["at"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    ends = _jump(steps)
    top = F.max("top")
    folds = materialise(ends.groupBy("id").agg(
        F.when(F.max("open"), top).otherwise(F.max(F.when(F.col("way") == -1, F.col("at")))).alias("head"),
        F.when(F.max("open"), top).otherwise(F.max(F.when(F.col("way") == 1, F.col("at")))).alias("tail"),
    ))
    bridges = folds.where(F.col("head") != F.col("tail")).select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    rest = links.join(inner.withColumnRenamed("id", "src"), "src", "left_anti").join(
        inner.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return stage_table(rest.unionByName(bridges).distinct(), "links"), folds.where(F.col("id") != F.col("head"))


def _reduce(links: DataFrame, folds: list[DataFrame]) -> tuple[DataFrame, int]:
    """Peel dead ends and fold mutual links and chains while it pays: (links, their number).

    Long chains and trees take a number of rounds that grows with the
    logarithm of their depth. ``folds`` gets tables of (id, head, tail): the
    node is in a component with others just if ``head`` and ``tail`` are in one.
    Folded links are written as tables: over checkpoints alone the time to
    plan a round multiplied with every fold, whatever the number of rows.
    """
    n = links.count()
    while n:
        links = materialise(_peel(links, _degrees(links)))
        left = links.count()
        # Peeling goes on alone while it pays; what it leaves slowly is long and narrow, which folding shortens.
        if left and left > n - n / 8:
            links, mutual = _fold_mutual(links)
            links, chains = _fold_chains(links, _degrees(links))
            folds += [mutual, chains]
            left = links.count()
            # Long and narrow graphs lose a third or more; the search takes what folding leaves slowly, too.
            if left > n - n / 8:
                n = left
                break
        n = left
    return links, n


def _unfold(labels: DataFrame, folds: Sequence[DataFrame]) -> DataFrame:
    """Labels of all nodes, those folded away included, each component named by its greatest id."""
    for folded in reversed(folds):
        if folded.isEmpty():
            continue
        kept = labels.join(folded.select("id"), "id", "left_anti")
        of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"at_{end}"))
        both = attach(attach(folded, of("head"), ["head"]), of("tail"), ["tail"])
        same = F.col("at_head") == F.col("at_tail")
        labels = materialise(kept.unionByName(
            both.select("id", F.when(same, F.col("at_head")).otherwise(F.col("id")).alias("component"))))
    names = labels.groupBy("component").agg(F.max("id").alias("_name")).where(F.col("_name") != F.col("component"))
    return attach(labels, names, ["component"], "left").select("id", F.coalesce("_name", "component").alias("component"))


def _colours(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Per node the greatest id that reaches it.

    A node keeps its colour unless a greater one is offered; ``since`` is the
    round it got it in, so the nodes to spread next are those of the last round.
    """
    state = materialise(ids.select("id", F.col("id").alias("colour"), F.lit(0).alias("since")))
    turn = 0
    with bucketed(links, "src") as table:
        while True:
            active = state.where(F.col("since") == turn)
            turn += 1
            offers = active.join(table, active["id"] == table["src"]).select(
                F.col("dst").alias("id"), "colour", F.lit(turn).alias("since"))
            best = F.max(F.struct(F.col("colour"), (-F.col("since")).alias("age")))
            state = materialise(
                state.unionByName(offers).groupBy("id").agg(best.alias("b"))
                .select("id", "b.colour", (-F.col("b.age")).alias("since")))
            if state.where(F.col("since") == turn).isEmpty():
                return state.select("id", "colour")


def _same_colour(links: DataFrame, colour: DataFrame) -> DataFrame:
    a = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca"))
    b = colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
    return links.join(a, "src").join(b, "dst").where(F.col("ca") == F.col("cb")).select("src", "dst")


def strong_components(edges: DataFrame) -> DataFrame:
    """Strong component of every node: (id, component), named by its greatest id."""
    return _components(edges, largest_only=False)


def _components(edges: DataFrame, largest_only: bool) -> DataFrame:
    """Labels of all nodes; with ``largest_only`` only the largest component's label can be trusted.

    Dead ends, mutual links and chains go first, in rounds that grow with the
    logarithm of their depth. Of what is left comes the component around the
    best-connected node, which on a road network is nearly everything; then
    all others in parallel by colouring: a node coloured by itself is a root,
    and its component is what reaches it inside its colour. With
    ``largest_only`` it stops once the rest, with all folded nodes, is too
    small to hold a larger component.
    """
    links = materialise(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    every = materialise(
        edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct())
    found: list[DataFrame] = []
    folds: list[DataFrame] = []
    best = 1
    links, n_links = _reduce(links, folds)
    if n_links:
        pivot = materialise(
            _degrees(links).select("id", (F.col("outs") * F.col("ins")).alias("d")).orderBy(F.desc("d"), "id").limit(1).select("id"))
        back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        core = materialise(reachable(links, pivot).join(reachable(back, pivot), "id", "left_semi"))
        name = core.agg(F.max("id")).first()[0]
        found.append(core.withColumn("component", F.lit(name)))
        best = core.count()
        links = links.join(core.withColumnRenamed("id", "src"), "src", "left_anti").join(
            core.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        links, n_links = _reduce(materialise(links), folds)
    while n_links:
        ids = materialise(
            links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct())
        # An equal-sized rival may still win the tie by its smaller id.
        if largest_only and ids.count() + sum(f.count() for f in folds) < best:
            break
        colour = _colours(links, ids)
        inside = materialise(_same_colour(links, colour))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where(F.col("id") == F.col("colour")).select("id")
        part = materialise(reachable(back, roots).join(colour, "id").select("id", F.col("colour").alias("component")))
        found.append(part)
        done = part.select("id")
        links, n_links = _reduce(materialise(
            inside.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(
                done.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")), folds)
    labels = every.withColumn("component", F.col("id"))
    if found:
        cyclic = _union(found)
        labels = cyclic.unionByName(labels.join(cyclic.select("id"), "id", "left_anti"))
    return _unfold(labels, folds)


def largest_scc(edges: DataFrame) -> DataFrame:
    """Ids of the largest strong component; equal sizes go to the one with the smallest id."""
    labels = materialise(_components(edges, largest_only=True))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    winner = sizes.orderBy(F.desc("n"), "lo").limit(1).select("component").scalar()
    return labels.where(F.col("component") == winner).select("id")


def is_strongly_connected(edges: DataFrame) -> DataFrame:
    labels = strong_components(edges)
    return labels.agg((F.countDistinct("component") == 1).alias("strongly_connected"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    keep = ids.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "length")


def _relaxed(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """What ``nodes`` offer to the ends of their roads."""
    return nodes.join(roads, nodes["node"] == roads["src"]).select(
        "source", F.col("dst").alias("node"), (F.col("dist") + F.col("length")).alias("dist"),
        (F.col("hops") + 1).alias("hops"), F.col("src").alias("pred"))


def _best_offer(offers: DataFrame) -> DataFrame:
    """Per source and node the shortest offer, of equal ones that with fewest roads, then from the smallest id.

    ``since`` is the round in which that distance and number of roads came up first.
    """
    best = offers.groupBy("source", "node").agg(
        F.min(F.struct("dist", "hops", "pred")).alias("b"), F.min(F.struct("dist", "hops", "since")).alias("s"))
    return best.select("source", "node", "b.dist", "b.hops", "b.pred", "s.since")


def shortest_paths(edges: DataFrame, sources: Sequence[int], delta: float | None = None) -> DataFrame:
    """Distance and predecessor from each source to every node it reaches.

    Columns source, node, dist, pred; lengths must not be negative. Of equally
    short paths those with fewest roads count, then the smallest predecessor.

    Delta-stepping: nodes with an offer wait until the nearest of them is
    less than ``delta`` closer than they are. The nodes of such a bucket are
    relaxed round by round over roads that stay within it; then they are
    final, are added to a table bucketed like the offers, and relax the roads
    that lead out of the bucket, once. A round shuffles only nodes of its
    bucket and their offers. ``delta`` decides on work, not on results: small
    ones repeat fewer relaxations, large ones take fewer rounds. By default
    it is ROADS_IN_BUCKET times the longest road.
    """
    spark = edges.sparkSession
    id_type = edges.schema["src"].dataType
    ids = list(dict.fromkeys(sources))
    waiting = spark.createDataFrame([(i,) for i in ids], "source long").select(
        F.col("source").cast(id_type).alias("source"), F.col("source").cast(id_type).alias("node"),
        F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast(id_type).alias("pred"))
    key = ["source", "node"]
    with bucketed(min_edges(edges), "src") as roads, growing(spark, key) as final:
        if delta is None:
            delta = ROADS_IN_BUCKET * (roads.agg(F.max("length")).first()[0] or 1.0)
        if not delta > 0:
            raise ValueError("delta must be positive")

        def unsettled(offers: DataFrame) -> DataFrame:
            """The best offers, without those to final nodes, which come too late."""
            best = _best_offer(offers)
            return best if final.rows is None else best.join(final.rows.select(key), key, "left_anti")

        while True:
            waiting, low = watched(unsettled(waiting.withColumn("since", F.lit(0))), F.min("dist"))
            if low is None:
                break
            # Not a multiple of delta: no sum with a road of at least delta is rounded to below it.
            limit = low + delta
            near, turn = waiting.where(F.col("dist") < limit), 0
            light = roads.where(F.col("length") < delta)
            while True:
                offers = _relaxed(near.where(F.col("since") == turn), light).where(F.col("dist") < limit)
                turn += 1
                near, newest = watched(unsettled(near.unionByName(offers.withColumn("since", F.lit(turn)))), F.max("since"))
                if newest < turn:
                    break
            near = near.drop("since")
            final.add(near)
            waiting = waiting.drop("since").unionByName(_relaxed(near, roads)).where(F.col("dist") >= limit)
        rows = waiting if final.rows is None else final.stored()
        return rows.select("source", "node", "dist", "pred")


def distance_matrix(paths: DataFrame, hotspots: Sequence[int]) -> DataFrame:
    """All ordered pairs of distinct hotspot nodes; an unreachable pair has a null distance.

    ``pos`` is the position of the source in the list. The list is a parameter
    (one node per hotspot), so its pairs are small.
    """
    ids = list(dict.fromkeys(hotspots))
    pairs = [(i, a, b) for i, a in enumerate(ids) for b in ids if a != b]
    frame = paths.sparkSession.createDataFrame(pairs, "pos int, source long, target long")
    ends = paths.where(F.col("node").isin(ids)).select("source", F.col("node").alias("target"), "dist")
    return frame.join(ends, ["source", "target"], "left")


def unreachable_pairs(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("dist").isNull()).select("source", "target")


def mutual_set(matrix: DataFrame) -> DataFrame:
    """Largest set of hotspots that all reach each other; ties go to the earliest listed.

    Mutual reachability is an equivalence, so a node's set is named by the
    earliest listed node it shares a round trip with.
    """
    there = matrix.where(F.col("dist").isNotNull()).select("source", "target", "pos")
    back = there.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("pos").alias("tpos"))
    nodes = matrix.select("source", "pos").distinct()
    mates = there.join(back, ["source", "target"]).groupBy("source").agg(F.min("tpos").alias("mate"))
    named = nodes.join(mates, "source", "left").withColumn("set", F.least("pos", "mate"))
    first = named.groupBy("set").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "set").limit(1).select("set").scalar()
    return named.where(F.col("set") == first).select(F.col("source").alias("node"), "pos")


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nearest-neighbour walk over one district's small distance matrix."""
    legs = pdf.dropna(subset=["dist"])
    node = pdf.sort_values("pos")["source"].iloc[0]
    stops = [(node, None)]
    visited = {node}
    while True:
        options = legs[(legs["source"] == node) & ~legs["target"].isin(visited)]
        if options.empty:
            break
        nearest = options.sort_values(["dist", "target"]).iloc[0]
        node = nearest["target"]
        visited.add(node)
        stops.append((node, nearest["dist"]))
    return pd.DataFrame({
        "district": pdf["district"].iloc[0],
        "seq": range(len(stops)),
        "node": [int(n) for n, _ in stops],
        "leg": pd.array([d for _, d in stops], dtype="Float64"),
    })


def greedy_tour(matrix: DataFrame, by: str | None = None) -> DataFrame:
    """Visit the nearest unvisited hotspot until none is reachable: district, seq, node, leg.

    Starts at the first listed hotspot. A group is the K x K matrix of one
    district, with K the number of hotspots asked for.
    """
    district = F.col(by).cast("string") if by else F.lit("all")
    columns = matrix.select(district.alias("district"), "pos", "source", "target", "dist")
    return columns.groupBy("district").applyInPandas(_walk, "district string, seq int, node long, leg double")


def expand_route(tour: DataFrame, paths: DataFrame) -> DataFrame:
    """Full node sequence of a tour: district, position, node.

    Each leg is walked back over the predecessors of its start, by pointers
    whose reach doubles, so a leg of n nodes takes log2(n) rounds; the end of a
    leg is the start of the next one and appears once.
    """
    w = Window.partitionBy("district").orderBy("seq")
    legs = materialise(
        tour.select("district", "seq", F.col("node").alias("source"), F.lead("node").over(w).alias("node"),
                    F.lead("leg").over(w).alias("leg")).where(F.col("node").isNotNull()))
    # Only nodes not farther than the leg's end can lie on it.
    limits = legs.groupBy("source").agg(F.max("leg").alias("limit"))
    near = materialise(
        paths.join(limits, "source").where(F.col("dist") <= F.col("limit")).select("source", "node", "pred"))
    # Ancestors one, two, four, ... steps back: the walked parts double with every round.
    walked = legs.select("district", "seq", "source", "node", F.lit(0).alias("back"))
    jump, span = near.where(F.col("pred").isNotNull()).select("source", "node", F.col("pred").alias("up")), 1
    while True:
        further = materialise(walked.join(jump, ["source", "node"]).select(
            "district", "seq", "source", F.col("up").alias("node"), (F.col("back") + span).alias("back")))
        if further.isEmpty():
            break
        walked = materialise(walked.unionByName(further))
        onward = jump.select("source", F.col("node").alias("up"), F.col("up").alias("beyond"))
        jump = materialise(jump.join(onward, ["source", "up"]).select("source", "node", F.col("beyond").alias("up")))
        span *= 2
    last = tour.groupBy("district").agg(F.max("seq").alias("seq"), F.max_by("node", "seq").alias("node")).select(
        "district", "seq", "node", F.lit(1).alias("back"))
    walked = walked.where("back > 0").select("district", "seq", "node", "back").unionByName(last)
    lengths = walked.groupBy("district", "seq").agg(F.max("back").alias("size"))
    offsets = lengths.withColumn("start", F.sum("size").over(w) - F.col("size"))
    return walked.join(offsets, ["district", "seq"]).select(
        "district", (F.col("start") + F.col("size") - F.col("back")).cast("int").alias("position"), "node")


def route_summary(route: DataFrame, tour: DataFrame, edges: DataFrame, n_hotspots: int) -> DataFrame:
    """Nodes, length, coverage and mean distance per visited hotspot, per district."""
    roads = min_edges(edges)
    after = route.select("district", (F.col("position") - 1).alias("position"), F.col("node").alias("dst"))
    hops = route.withColumnRenamed("node", "src").join(after, ["district", "position"])
    # A route is short next to the road table, so it is the side worth moving.
    metres = hops.join(roads, ["src", "dst"]).groupBy("district").agg(F.sum(F.col("length").cast("decimal(28,6)")).alias("metres"))
    sizes = route.groupBy("district").agg(F.count(F.lit(1)).alias("route_nodes"))
    stops = tour.groupBy("district").agg(F.count(F.lit(1)).alias("visited"))
    length = F.coalesce(F.col("metres").cast("double"), F.lit(0.0))
    return (
        stops.join(sizes, "district").join(metres, "district", "left")
        .select(
            "district", "visited", "route_nodes",
            length.alias("metres"),
            (F.col("visited") * 100.0 / F.lit(float(n_hotspots))).alias("coverage_pct"),
            (length / 1000 / F.col("visited")).alias("km_per_hotspot"),
        )
    )


