"""Graph operators over edge tables: cycles, reach, paths, neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tanglemap.scratch import cut


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes."""
    return edges.select("src", "dst").filter("src <> dst and src is not null and dst is not null").distinct()


def _degrees(edges: DataFrame) -> DataFrame:
    """``node``, edges in and out, and one neighbour on either side."""
    ends = edges.select(F.col("src").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("before"), F.col("dst").alias("after"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("before"), F.lit(None).cast(edges.schema["src"].dataType).alias("after")))
    return ends.groupBy("node").agg(F.count("before").alias("n_in"), F.count("after").alias("n_out"), F.min("before").alias("before"), F.min("after").alias("after"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    gone = nodes.select("node")
    return edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")


def _raked(edges: DataFrame) -> DataFrame:
    """Without the nodes that have no edge in or none out; they are on no cycle."""
    return _without(edges, _degrees(edges).filter("n_in = 0 or n_out = 0"))


def _links_of_chains(edges: DataFrame, salt: int) -> DataFrame:
    """``node, before, after``: nodes of one edge in and one out, no two of them neighbours: those
    whose hash is below that of their neighbours of the kind, at least a third on average."""
    links = _degrees(edges).filter("n_in = 1 and n_out = 1").select("node", "before", "after", F.xxhash64(F.lit(salt), "node").alias("h"))
    beside = links.select(F.col("node").alias("other"), F.col("h").alias("h_other"))
    for side in ("before", "after"):
        links = links.join(beside, F.col(side) == F.col("other"), "left").filter("h_other is null or h < h_other").select("node", "before", "after", "h")
    return links.select("node", "before", "after")


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rakes ends off and replaces nodes of chains by an edge between their neighbours, while a
    round leaves less than nine tenths of the edges. Returns the rest and, in order, the nodes
    taken out of chains: such a node is on a cycle with its neighbours if these are on one
    together, or if they are one node. Tails and rings shrink by half a round and more."""
    taken: list[DataFrame] = []
    size = edges.count()
    while size:
        at = _raked(edges)
        for _ in range(2):
            links = cut(_links_of_chains(at, len(taken)))
            if links.isEmpty():
                break
            taken.append(links)
            at = _without(at, links).union(links.filter("before <> after").select("before", "after")).distinct()
        edges = cut(at)
        now = edges.count()
        if now > 0.9 * size:
            return edges, taken
        size = now
    return edges, taken


def _least_ancestor(edges: DataFrame) -> DataFrame:
    """``node, label``: of all nodes with a path to the node, and the node, the one of least hash.
    A round takes over the labels of predecessors and, as a shortcut, the label of the labelled
    node itself, so rounds go with the logarithm of path lengths."""
    label = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    at = nodes.select("node", label("node").alias("label"))
    while True:
        known = at.select(F.col("node").alias("key"), F.col("label").alias("sent"))
        by_edge = edges.join(known, F.col("src") == F.col("key")).select(F.col("dst").alias("node"), F.col("sent").alias("label"))
        by_jump = at.join(known, F.col("label.node") == F.col("key")).select("node", F.col("sent").alias("label"))
        offered = by_edge.union(by_jump).groupBy("node").agg(F.min("label").alias("offer"))
        best = F.least("label", F.coalesce("offer", "label"))
        moved = cut(at.join(offered, "node", "left").select("node", best.alias("label"), (best < F.col("label")).alias("moved")))
        at = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return at.select("node", F.col("label.node").alias("label"))


def scc_cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: ``component`` (smallest member)
    and ``members`` (sorted). Self-loops are no cycles.

    Repeatedly: contract tails and chains; label each node with the least node that reaches
    it and, among nodes of one label, with the least one it reaches. Where both are the same
    node, its component is whole; of the rest only edges between equal pairs of labels can be
    on a cycle. Rounds go with the logarithm of path lengths, work per round is a join of
    edges with labels, and nothing but counts and emptiness reach the driver."""
    rest = cut(simple(edges))
    found, taken = [], []
    while True:
        rest, links = _contracted(rest)
        taken += links
        if rest.isEmpty():
            break
        above = _least_ancestor(rest)
        inner = cut(rest.join(above.toDF("src", "c1"), "src").join(above.toDF("dst", "c2"), "dst").filter("c1 = c2").select("src", "dst"))
        below = _least_ancestor(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        pairs = cut(above.join(below.withColumnRenamed("label", "least"), "node").select("node", "label", "least"))
        done = pairs.filter("label = least")
        found.append(done.select("node", F.col("label").alias("component")))
        open_ = pairs.filter("label <> least").select("node", F.struct("label", "least").alias("p"))
        rest = cut(inner.join(open_.toDF("src", "p1"), "src").join(open_.toDF("dst", "p2"), "dst").filter("p1 = p2").select("src", "dst"))

    def union(parts: list[DataFrame], *columns: Column) -> DataFrame:
        out = edges.select(*columns).limit(0)
        for part in parts:
            out = out.unionByName(part)
        return out

    node, component = F.col("src").alias("node"), F.col("src").alias("component")
    whole = union(found, node, component)
    sizes = whole.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    placed = [cut(whole.join(sizes.select("component"), "component", "left_semi").select("node", "component"))]
    # where a chain closes on a node, that is on a cycle with what was taken out, whatever becomes of it
    rings = cut(union([links.filter("before = after").select(F.col("before").alias("node")) for links in taken], node).distinct())
    inside = union([links.select("node") for links in taken], node)
    alone = rings.join(placed[0].select("node"), "node", "left_anti").join(inside, "node", "left_anti")
    placed.append(cut(alone.select("node", F.col("node").alias("component"))))
    for links in reversed(taken):
        sides = links.select("node", F.explode(F.array("before", "after")).alias("beside"))
        known = union(placed, node, component).select(F.col("node").alias("beside"), "component")
        agreed = sides.join(known, "beside", "left").groupBy("node").agg(F.count("component").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        agreed = agreed.join(rings.withColumn("ring", F.lit(True)), "node", "left")
        own = F.when((F.col("n") == 2) & (F.col("low") == F.col("high")), F.col("low")).when(F.col("ring"), F.col("node"))
        placed.append(cut(agreed.select("node", own.alias("component"))).filter("component is not null"))
    members = union(placed, node, component).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return members.select(F.col("members")[0].alias("component"), "members")


def _reached(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int) -> tuple[DataFrame, int]:
    """``node, depth`` of what is met, and the depth reached: a last round that finds nothing
    counts, one that brings the total beyond ``max_nodes`` does not, though its nodes stay."""
    links = simple(edges)
    both = cut(links.union(links.select("dst", "src")).distinct())
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    total = seen.count()
    reached = 0
    while total and reached < max_depth:
        front = seen.filter(F.col("depth") == reached).select(F.col("node").alias("src"))
        fresh = both.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = cut(seen.unionByName(fresh.withColumn("depth", F.lit(reached + 1))))
        now = seen.count()
        if now > max_nodes:
            break
        reached += 1
        if now == total:
            break
        total = now
    return seen, reached


def impact_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_nodes: int = 500) -> DataFrame:
    """Nodes within ``max_depth`` undirected steps of ``seeds(node)``: ``node``, ``depth`` and
    ``role`` (seed or impacted). A round that brings the total beyond ``max_nodes`` is still
    in the result and the last. Work per round is one join of the frontier with the edges."""
    seen, _ = _reached(edges, seeds, max_depth, max_nodes)
    return seen.select("node", "depth", F.when(F.col("depth") == 0, "seed").otherwise("impacted").alias("role"))


@dataclass
class Impact:
    """What a change of files touches."""

    changed: DataFrame  # nodes of the changed files
    impacted: DataFrame  # other known nodes that are met
    files: DataFrame  # file_path of the impacted nodes
    edges: DataFrame  # edges among changed and impacted nodes
    depth: int


def impact_of_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, max_depth: int = 2, max_nodes: int = 500) -> Impact:
    """:func:`impact_radius` from all nodes of ``files(file_path)``; what is met but is no known
    node (such as an external module) does not count."""
    changed = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(*nodes.columns)
    seen, depth = _reached(edges, changed.select(F.col("qualified_name").alias("node")), max_depth, max_nodes)
    met = seen.filter("depth > 0").select(F.col("node").alias("qualified_name"))
    impacted = nodes.join(met, "qualified_name", "left_semi").select(*nodes.columns)
    inside = changed.select(F.col("qualified_name").alias("node")).union(impacted.select("qualified_name"))
    return Impact(changed, impacted, impacted.select("file_path").distinct(), induced_edges(edges, inside), depth)


def dependency_chain(edges: DataFrame, root, max_depth: int = 5) -> DataFrame:
    """Shortest chains from ``root`` along out-edges: ``node``, ``depth``, ``chain``; each
    reachable node once, by its smallest shortest path. Breadth-first, so it parallelises; a
    depth-first walk may show other chains to the same nodes."""
    links = cut(simple(edges))
    start = links.filter((F.col("src") == root) | (F.col("dst") == root)).select(F.lit(root).cast(links.schema["src"].dataType).alias("node")).distinct()
    seen = cut(start.select("node", F.lit(0).alias("depth"), F.array("node").alias("chain")))
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1).select(F.col("node").alias("src"), "chain")
        step = links.join(front, "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        fresh = step.groupBy(F.col("dst").alias("node")).agg(F.min("chain").alias("chain")).select("node", F.lit(depth).alias("depth"), F.concat("chain", F.array("node")).alias("chain"))
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh))
    return seen.filter("depth > 0")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node)``."""
    inside = nodes.select("node").distinct()
    return edges.join(inside.toDF("src"), "src", "left_semi").join(inside.toDF("dst"), "dst", "left_semi").select(*edges.columns)


def callers_of(edges: DataFrame, nodes: DataFrame, target: str) -> DataFrame:
    """Known nodes that call the target, one row a call."""
    calls = edges.filter((F.col("kind") == "CALLS") & (F.col("dst") == target)).select("src", "line")
    return calls.join(nodes, calls.src == nodes.qualified_name).select("qualified_name", "name", "file_path", "line")


def callees_of(edges: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    calls = edges.filter((F.col("kind") == "CALLS") & (F.col("src") == source)).select("dst", "line")
    return calls.join(nodes, calls.dst == nodes.qualified_name).select("qualified_name", "name", "file_path", "line")


def outgoing(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    return edges.filter((F.col("src") == node) & (F.lit(kind is None) | (F.col("kind") == kind)))


def incoming(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    return edges.filter((F.col("dst") == node) & (F.lit(kind is None) | (F.col("kind") == kind)))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files and kinds."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files"), F.count_distinct("kind").alias("kinds"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each


def index_stats(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """One row: file nodes, all nodes and edges, embeddings, and the languages, sorted."""
    languages = F.array_sort(F.collect_set(F.when(F.col("language") != "", F.col("language"))))
    n = nodes.agg(F.count_if(F.col("kind") == "File").alias("files"), F.count("*").alias("total_nodes"), languages.alias("languages"))
    out = n.join(F.broadcast(edges.agg(F.count("*").alias("total_edges"))))  # one row each
    if embeddings is None:
        return out.withColumn("embeddings", F.lit(0).cast("long"))
    return out.join(F.broadcast(embeddings.agg(F.count("*").alias("embeddings"))))
