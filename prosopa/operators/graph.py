"""Undirected person graphs: building, projections, centralities, bounded paths, roles, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopa.operators.attributes import earliest, pick
from prosopa.session import cut, cut_told, hot_keys, slice_join


def relations(*sources: tuple[DataFrame, str, str, str, str]) -> DataFrame:
    """(source < target, kind, code) with one row for each unordered pair, from (rows, end, end, code,
    kind) in falling priority. Null, 0 and equal ends are dropped. Of a pair's rows the first kind
    wins, within a kind the smallest code (a null code last)."""
    rows = None
    for priority, (df, a, b, code, kind) in enumerate(sources):
        part = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != 0) & (F.col(b) != 0) & (F.col(a) != F.col(b))).select(
            F.least(a, b).cast("long").alias("source"), F.greatest(a, b).cast("long").alias("target"),
            F.lit(priority).alias("priority"), F.col(code).isNull().alias("no_code"), F.col(code).cast("int").alias("code"), F.lit(kind).alias("kind"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return earliest(rows, ["source", "target"], ["priority", "no_code", "code"]).select("source", "target", "kind", "code")


def edges_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (source < target) of pairs without nulls and self links."""
    ends = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.select(F.least(a, b).cast("long").alias("source"), F.greatest(a, b).cast("long").alias("target")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour) in both directions."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))
    )


def induced(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges between retained nodes, weight 1. Nodes without edges live in the node table."""
    keep = nodes.select(F.col(node).alias("_keep")).distinct()
    inner = edges.join(keep, F.col("source") == F.col("_keep"), "left_semi").join(keep, F.col("target") == F.col("_keep"), "left_semi")
    return inner.select("source", "target").distinct().withColumn("weight", F.lit(1).cast("long"))


def projection(edges: DataFrame, nodes: DataFrame, node: str = "id", rows_per_slice: int = 2048) -> DataFrame:
    """(source < target, weight): retained nodes that share a neighbour, with how many they share. Hubs
    may be any node. A hub's neighbours are cut into slices, so its pairs form in many tasks."""
    keep = nodes.select(F.col(node).alias("_keep")).distinct()
    near = adjacency(edges).distinct().join(keep, F.col("node") == F.col("_keep"), "left_semi")
    a = near.select(F.col("neighbour").alias("hub"), F.col("node").alias("source"))
    b = near.select(F.col("neighbour").alias("hub"), F.col("node").alias("target"))
    pair = slice_join(b, a, ["hub"], ["target"], rows_per_slice).where(F.col("source") < F.col("target"))
    return pair.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def build_graph(edges: DataFrame, nodes: DataFrame, mode: str, node: str = "id") -> DataFrame:
    if mode == "induced":
        return induced(edges, nodes, node)
    if mode == "projection":
        return projection(edges, nodes, node)
    raise ValueError(f"unknown graph mode: {mode}")


def degrees(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """(id, degree) for every node, 0 for those without edges."""
    counted = adjacency(edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(F.col(node).alias("id")).distinct().join(counted, "id", "left").na.fill(0, ["degree"])


def clustering(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """(id, triangles, clustering): closed neighbour pairs among all, 0 below degree 2.

    Edges point from the lower to the higher degree, so each wedge is listed at its least connected
    corner and a hub lists no more than about the square root of twice the edges.
    """
    deg = degrees(edges, nodes, node).withColumnRenamed("id", "_id")
    ends = edges.select("source", "target")
    da, db = deg.select(F.col("_id").alias("source"), F.col("degree").alias("ds")), deg.select(F.col("_id").alias("target"), F.col("degree").alias("dt"))
    known = ends.join(da, "source").join(db, "target")
    up = (F.col("ds") < F.col("dt")) | ((F.col("ds") == F.col("dt")) & (F.col("source") < F.col("target")))
    way = known.select(F.when(up, F.col("source")).otherwise(F.col("target")).alias("low"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("high"))
    wedge = way.alias("p").join(way.alias("q"), F.col("p.low") == F.col("q.low")).where(F.col("p.high") < F.col("q.high"))
    wedge = wedge.select(F.col("p.low").alias("corner"), F.col("p.high").alias("source"), F.col("q.high").alias("target"))
    closed = wedge.join(ends, ["source", "target"])
    each = closed.select(F.explode(F.array("corner", "source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    row = degrees(edges, nodes, node).join(each, "id", "left").na.fill(0, ["triangles"])
    rate = F.when(F.col("degree") >= 2, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return row.select("id", "triangles", rate.alias("clustering"))


def two_hop(edges: DataFrame, rows_per_slice: int = 2048) -> DataFrame:
    """Distinct (node, other) at distance exactly two. A hub's neighbours are cut into slices."""
    near = adjacency(edges).distinct()
    ends = near.select(F.col("neighbour").alias("hub"), "node")
    far = slice_join(ends, ends.withColumnRenamed("node", "other"), ["hub"], ["node"], rows_per_slice).select("node", "other")
    return far.where(F.col("node") != F.col("other")).distinct().join(near.withColumnRenamed("neighbour", "other"), ["node", "other"], "left_anti")


def _outcomes(nodes: DataFrame, outcome: str, node: str, id_: str, y: str) -> DataFrame:
    """One outcome for each node: the greatest of its rows, 0 where none is known."""
    return nodes.groupBy(F.col(node).alias(id_)).agg(F.coalesce(F.max(F.col(outcome).cast("long")), F.lit(0)).alias(y))


def contagion(edges: DataFrame, nodes: DataFrame, outcome: str, node: str = "id") -> DataFrame:
    """(id, contagion, indirect_contagion): the outcome summed over neighbours and over nodes two away. Of
    a node's rows that differ the greatest outcome counts."""
    y = _outcomes(nodes, outcome, node, "other", "y")
    direct = adjacency(edges).withColumnRenamed("neighbour", "other").join(y, "other").groupBy(F.col("node").alias("id")).agg(F.sum("y").alias("contagion"))
    second = two_hop(edges).join(y, "other").groupBy(F.col("node").alias("id")).agg(F.sum("y").alias("indirect_contagion"))
    ids = nodes.select(F.col(node).alias("id")).distinct()
    return ids.join(direct, "id", "left").join(second, "id", "left").na.fill(0, ["contagion", "indirect_contagion"])


def co_outcome_edges(edges: DataFrame, nodes: DataFrame, outcome: str, node: str = "id") -> DataFrame:
    """One row: how many edges there are and how many have the outcome at both ends."""
    y = _outcomes(nodes, outcome, node, "_n", "_y")
    both = edges.join(y.select(F.col("_n").alias("source"), F.col("_y").alias("ys")), "source", "left").join(y.select(F.col("_n").alias("target"), F.col("_y").alias("yt")), "target", "left")
    return both.agg(F.count(F.lit(1)).alias("edges"), F.count_if((F.col("ys") == 1) & (F.col("yt") == 1)).alias("both_ones"))


def bounded_paths(edges: DataFrame, mains: DataFrame, highs: DataFrame, max_distance: int = 6, max_paths: int = 8) -> DataFrame:
    """(main, high, distance, path): for each main the first `max_paths` highs in (distance, path)
    order, each with its lexicographically smallest shortest path; highs are passed through as well.

    One join per level: the frontier holds each (main, node) once, with its smallest path; reached
    pairs are kept out by an anti-join and mains with enough finds drop out.
    """
    near = cut(adjacency(edges).distinct())
    high = highs.select(F.col("id").alias("node")).distinct()
    start = mains.select(F.col("id").alias("main")).distinct()
    frontier = start.select("main", F.col("main").alias("node"), F.array("main").alias("path"))
    seen, found = frontier.select("main", "node"), None
    for distance in range(1, max_distance + 1):
        step = slice_join(frontier, near, ["node"], ["main"], 65536).select("main", F.col("neighbour").alias("node"), F.concat("path", F.array("neighbour")).alias("path"))
        fresh = step.join(seen, ["main", "node"], "left_anti").groupBy("main", "node").agg(F.min("path").alias("path"))
        frontier = cut(fresh)
        hit = frontier.join(high, "node", "left_semi").select("main", F.col("node").alias("high"), F.lit(distance).alias("distance"), "path")
        found = hit if found is None else cut(found.unionByName(hit))
        if distance < max_distance:
            done = found.groupBy("main").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_paths)
            seen = cut(seen.unionByName(frontier.select("main", "node")).join(done, "main", "left_anti"))
            frontier = cut(frontier.join(done, "main", "left_anti"))
            if frontier.isEmpty():
                break
    return pick(found, ["main"], [F.asc("distance"), F.asc("path")], max_paths).select("main", "high", "distance", "path")


def roles(edges: DataFrame, mains: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, node_type, is_main, is_high, is_bridge, is_direct) for mains, their neighbours (direct) and all nodes on
    paths; types in the order main, high, bridge, other."""
    main = mains.select("id").distinct()
    high = paths.select(F.col("high").alias("id")).distinct()
    on_path = paths.select(F.explode("path").alias("id")).distinct()
    bridge = on_path.join(main, "id", "left_anti").join(high, "id", "left_anti")
    direct = adjacency(edges).join(main, F.col("node") == F.col("id"), "left_semi").select(F.col("neighbour").alias("id"))
    flags = {"is_main": main, "is_high": high, "is_bridge": bridge, "is_direct": direct}
    flagged = None
    for name, rows in flags.items():
        part = rows.select("id", *(F.lit(n == name).alias(n) for n in flags))
        flagged = part if flagged is None else flagged.unionByName(part)
    row = flagged.groupBy("id").agg(*(F.bool_or(n).alias(n) for n in flags))
    kind = F.when(F.col("is_main"), "main").when(F.col("is_high"), "high").when(F.col("is_bridge"), "bridge").otherwise("other")
    return row.select("id", kind.alias("node_type"), *flags)


def role_edges(related: DataFrame, mains: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target, kind, code, category): edges of mains (direct) and edges that paths use (path).
    A pair can be there once in each category. `related` is from `relations`."""
    main = mains.select(F.col("id").alias("_m")).distinct()
    touched = related.join(main, F.col("source") == F.col("_m"), "left_semi").unionByName(related.join(main, F.col("target") == F.col("_m"), "left_semi")).distinct()
    steps = paths.select(F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))).alias("s"))
    used = steps.select(F.least("s.a", "s.b").alias("source"), F.greatest("s.a", "s.b").alias("target")).distinct()
    return touched.withColumn("category", F.lit("direct")).unionByName(related.join(used, ["source", "target"], "left_semi").withColumn("category", F.lit("path"))).distinct()


def check_graph(nodes: DataFrame, edges: DataFrame, node: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """(check_name, offenders, first): repeated node ids, edges with an end that is no node, self links."""
    ids = nodes.select(F.col(node).alias("id"))
    repeated = ids.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    ends = edges.select(F.explode(F.array(source, target)).alias("id")).where("id is not null").distinct()
    dangling = ends.join(ids.distinct(), "id", "left_anti")
    looped = edges.where(F.col(source) == F.col(target)).select(F.col(source).alias("id"))
    return _offences(repeated, "repeated_node").unionByName(_offences(dangling, "dangling_edge")).unionByName(_offences(looped, "self_link"))


def _offences(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("offenders"), F.min("id").alias("first")).select(F.lit(name).alias("check_name"), "offenders", "first")


def check_paths(nodes: DataFrame, paths: DataFrame, summary: DataFrame, edges: DataFrame) -> DataFrame:
    """(check_name, offenders, first): paths whose main is no main node, whose high is no high node, or that pass
    a node that isn't there, and counts of `summary` (`network_summary`) that differ from the tables."""
    lacking = lambda rows, kept: rows.where("id is not null").join(kept.select("id"), "id", "left_anti")
    main = lacking(paths.select(F.col("main").alias("id")), nodes.where("is_main"))
    high = lacking(paths.select(F.col("high").alias("id")), nodes.where("is_high"))
    passed = lacking(paths.select(F.explode("path").alias("id")), nodes)
    rows = _offences(main, "path_main").unionByName(_offences(high, "path_high")).unionByName(_offences(passed, "path_node"))
    for metric, table in (("nodeCount", nodes), ("edgeCount", edges), ("pathCount", paths)):
        told, seen = summary.where(F.col("metric") == metric).select(F.col("value").alias("told")), table.agg(F.count(F.lit(1)).alias("seen"))
        off = told.crossJoin(seen).where(F.col("told") != F.col("seen")).select(F.col("told").alias("id"))
        rows = rows.unionByName(_offences(off, metric))
    return rows


def eigenvector(edges: DataFrame, nodes: DataFrame, node: str = "id", max_iterations: int = 2000, tolerance: float = 1e-8, checkpoint_every: int = 10) -> DataFrame:
    """(id, eigenvector): power iteration on A + I, scaled to length 1; 0 for all without edges.

    One join-and-sum per round. Only the number of nodes, the length and the change come to the driver. The change is
    looked at, and the lineage cut, every `checkpoint_every` rounds.
    """
    ids = cut(nodes.select(F.col(node).alias("id")).distinct())
    n = ids.count()
    near = adjacency(edges).distinct().withColumnRenamed("node", "id")
    if n == 0 or near.isEmpty():
        return ids.withColumn("eigenvector", F.lit(0.0))
    # A self link for each node makes a round one join and one sum of the last values.
    near = cut(near.unionByName(ids.select("id", F.col("id").alias("neighbour"))))
    value = ids.withColumn("v", F.lit(1.0 / n))
    for _ in range(0, max_iterations, checkpoint_every):
        for _ in range(checkpoint_every - 1):
            value = near.join(value.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg(F.sum("v").alias("v"))
        was = cut(value)
        now = cut(near.join(was.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg(F.sum("v").alias("v")))
        long = lambda df: df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
        was, value = was.select("id", (F.col("v") / long(was)).alias("was")), now.select("id", (F.col("v") / long(now)).alias("v"))
        change = value.join(was, "id").agg(F.sum(F.abs(F.col("v") - F.col("was")))).first()[0]
        if change < n * tolerance:
            return value.withColumnRenamed("v", "eigenvector")
    raise ValueError(f"eigenvector centrality didn't settle in {max_iterations} rounds")


def betweenness(edges: DataFrame, nodes: DataFrame, node: str = "id", pivots: int = 512, seed: int = 20260516) -> DataFrame:
    """(id, betweenness) for graphs of any size: all pivots' shortest-path searches advance together,
    one join per level, and their dependencies flow back one join per level.

    A row of state is one (pivot, node) that was reached, so the work is pivots x reached nodes. Searches go on
    until no new node is reached, however deep; the neighbours of a hub are sliced.
    """
    ids = cut(nodes.select(F.col(node).cast("long").alias("id")).distinct())
    n = ids.count()
    k = min(pivots, n)
    near = cut(adjacency(edges).distinct())
    # A level holds a node once for each pivot, so only a hub's neighbours can be many.
    hot = cut(hot_keys(near, ["node"], 65536))
    sliced = not hot.isEmpty()
    meet = lambda rows: slice_join(near, rows, ["node"], ["neighbour"], 65536, hot) if sliced else rows.join(near, "node")
    chosen = ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots)
    level = cut(chosen.select(F.col("id").alias("pivot"), "id", F.lit(1.0).alias("ways"), F.lit(0).alias("level")))
    levels = [level]
    while True:
        step = meet(level.withColumnRenamed("id", "node"))
        step = step.groupBy("pivot", F.col("neighbour").alias("id")).agg(F.sum("ways").alias("ways"))
        # A neighbour of one level lies on that level, the one before or the next, so older levels needn't be asked.
        old = levels[-1].select("pivot", "id") if len(levels) == 1 else levels[-1].select("pivot", "id").unionByName(levels[-2].select("pivot", "id"))
        level, told = cut_told(step.join(old, ["pivot", "id"], "left_anti").withColumn("level", F.lit(len(levels))), rows=F.count(F.lit(1)))
        if not told["rows"]:
            break
        levels.append(level)
    total, below = None, levels[-1].withColumn("share", F.lit(0.0))
    for upper in reversed(levels[:-1]):
        told = below.select("pivot", F.col("id").alias("from"), ((1 + F.col("share")) / F.col("ways")).alias("give"))
        back = meet(told.withColumnRenamed("from", "node")).select("pivot", F.col("neighbour").alias("id"), "give")
        got = upper.join(back, ["pivot", "id"], "left").groupBy("pivot", "id", "ways", "level").agg((F.first("ways") * F.coalesce(F.sum("give"), F.lit(0.0))).alias("share"))
        part = below.select("id", "share")
        total = part if total is None else total.unionByName(part)
        below = cut(got)
    scale = n / k / max((n - 1) * (n - 2), 1) if n > 2 else 0.0
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    summed = total.groupBy("id").agg((F.sum("share") * scale).alias("betweenness"))
    return ids.join(summed, "id", "left").na.fill(0.0, ["betweenness"])


def network_summary(roles: DataFrame, edges: DataFrame, paths: DataFrame, highs: DataFrame, offices: DataFrame, bureaus: DataFrame) -> DataFrame:
    """(metric, value) of a network: persons by role, edges by category, paths, mains with direct links and with
    paths, candidates and offices. `roles`, `role_edges` and `bounded_paths` give the first three; `highs` (id) are the
    candidates, `offices` has office and used, `bureaus` (id, bureau) the bureaus of the mains, which are
    counted as bureau_<name>."""
    one = lambda rows, *named: rows.agg(*(c.alias(n) for n, c in named))
    count = F.count_if
    node = one(
        roles, ("mainPersonCount", count(F.col("is_main"))), ("relatedHighOfficialCount", count(F.col("is_high"))), ("bridgeCount", count(F.col("is_bridge"))), ("nodeCount", F.count(F.lit(1))),
        ("directPersonCount", count(F.col("is_direct"))),
    )
    edge = one(edges, ("edgeCount", F.count(F.lit(1))), ("directEdgeCount", count(F.col("category") == "direct")), ("pathEdgeCount", count(F.col("category") == "path")))
    path = one(paths, ("pathCount", F.count(F.lit(1))), ("highPathCoveredMainCount", F.count_distinct("main")), ("maxHighPathDistanceSeen", F.coalesce(F.max("distance"), F.lit(0)).cast("long")))
    linked = edges.where("category = 'direct'").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    covered = one(roles.where("is_main").join(linked, "id", "left_semi"), ("mainWithDirectRelationsCount", F.count(F.lit(1))))
    high = one(highs.select("id").distinct(), ("highOfficialCandidateCount", F.count(F.lit(1))))
    office = one(offices, ("scienceOfficeCount", F.count_distinct("office")), ("usedScienceOfficeCount", F.count_distinct(F.when(F.col("used"), F.col("office")))))
    rows = bureaus.where("bureau is not null").groupBy(F.concat(F.lit("bureau_"), "bureau").alias("metric")).agg(F.count_distinct("id").alias("value"))
    for told in (node, edge, path, covered, high, office):
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in told.columns))
        rows = rows.unionByName(told.select(F.inline(pairs)))
    return rows


def network_view(
    nodes: DataFrame, edges: DataFrame, types: Sequence[str] | None = None, text: str | None = None, dynasty: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given types and dynasty whose id is the text or whose name has it, in either case of
    letters, and the edges between them. `nodes` has id, node_type, name and, for a dynasty, dynasty;
    a null field fits no condition."""
    shown = nodes if types is None else nodes.where(F.col("node_type").isin(*types))
    if dynasty is not None:
        shown = shown.where(F.col("dynasty") == dynasty)
    if text:
        shown = shown.where((F.col("id").cast("string") == text) | F.lower("name").contains(text.lower()))
    return shown, induced(edges, shown)
