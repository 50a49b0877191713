"""Strongly connected components of the import graphs of many projects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..scratch import broadcast_if_small, stored
from .files import top_of_project


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color) of nodes that are numbers: the least node that leads to each node, itself included.

    In each round a node takes the least color of itself, of the nodes before it and of
    the node that its own color names, which leads to it too. So a way is followed in
    steps that grow, and rounds with the logarithm of its length.
    """
    colors, state = stored(nodes.withColumn("color", F.col("node")), "colors"), None
    while True:
        now = colors.agg(F.sum(F.xxhash64("node", "color").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return colors
        state = now
        source = colors.select(F.col("node").alias("src"), F.col("color").alias("before"))
        reach = edges.join(source, "src").groupBy(F.col("dst").alias("node")).agg(F.min("before").alias("before"))
        jump = colors.select(F.col("node").alias("color"), F.col("color").alias("further"))
        met = colors.join(reach, "node", "left").join(jump, "color")
        colors = stored(met.select("node", F.least("color", "before", "further").alias("color")), "colors")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(node, color, end): the least node that leads to each node and the least that it leads to.

    Twice a number is the node on the ways along the edges, one more that on the ways
    back, so that one set of rounds finds both.
    """
    a, b = F.col("src") * 2, F.col("dst") * 2
    doubled = edges.select(F.inline(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct((b + 1).alias("src"), (a + 1).alias("dst")))))
    nodes = doubled.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    along = F.col("node") % 2 == 0
    color = F.shiftright("color", 1)
    found = _spread(nodes, doubled).groupBy(F.shiftright("node", 1).alias("node"))
    return found.agg(F.min(F.when(along, color)).alias("color"), F.min(F.when(~along, color)).alias("end"))


def _core(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """Edges without those of nodes that nothing leads to or that lead nowhere, which are in no cycle.

    They are peeled off in waves, as long as a wave takes a tenth of the edges that are
    left; a long thin way is left to the colors, which are through with it in fewer rounds.
    """
    n = edges.count()
    while n:
        into = edges.select(F.col("dst").alias("src")).distinct()
        out_of = edges.select(F.col("src").alias("dst")).distinct()
        edges = stored(edges.join(into, "src", "left_semi").join(out_of, "dst", "left_semi").select("src", "dst"), "core")
        left = edges.count()
        if n - left < share * n:
            break
        n = left
    return edges


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, node, id) of all nodes, and the edges between ids. The numbers have the order of the names; rounds join and compare them faster."""
    edges = stored(edges.where("src <> dst").select("project", "src", "dst").distinct(), "edges")
    ends = edges.select("project", F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = stored(ends.orderBy("project", "node").withColumn("id", F.monotonically_increasing_id()), "nodes")
    a, b = (nodes.select("project", F.col("node").alias(end), F.col("id").alias(f"{end}_id")) for end in ("src", "dst"))
    met = edges.join(a, ["project", "src"]).join(b, ["project", "dst"])
    return nodes, stored(met.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "numbered")


def cycles_of(edges: DataFrame) -> DataFrame:
    """(project, component, node) of components of two nodes at least; a component is named by its least node.

    Parallel edges and loops say nothing, nor do ways into and out of cycles, most of
    which go first. For each node the least that leads to it and
    the least that it leads to are found. Where they are the same, it is the node's
    component; an edge whose ends differ in either is in none and goes; the rest
    repeats. Every step is a join; the driver sees counts.
    """
    names, edges = _numbered(edges)
    found = edges.select(F.col("src").alias("component"), F.col("dst").alias("node")).where(F.lit(False))
    while not (edges := _core(edges)).isEmpty():
        both = stored(_both_ways(edges), "colored")
        found = found.unionByName(both.where("color = end").select(F.col("color").alias("component"), "node"))
        rest = both.where("color <> end")
        a = rest.select(F.col("node").alias("src"), "color", "end")
        b = rest.select(F.col("node").alias("dst"), "color", "end")
        edges = stored(edges.join(a, "src").join(b, ["dst", "color", "end"]).select("src", "dst"), "edges")
    # A component is so far named by its least number.
    found = found.withColumnsRenamed({"component": "of", "node": "id"}).join(names, "id").select("project", "of", "node")
    least = found.groupBy("of").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.join(least, "of").select("project", "component", "node")


def cycle_report(cycles: DataFrame, n: int = rules.TOP["cycles"], files: int = rules.TOP["cycle_files"]) -> DataFrame:
    """The largest cycles of a project with their first files, and how many there are."""
    own = ["project", "component"]
    sizes = cycles.groupBy(*own).agg(F.count("*").alias("size"))
    counts = sizes.groupBy("project").agg(F.count("*").alias("cycles"))
    top = top_of_project(sizes, n, F.col("size").desc(), F.col("component"))
    top = stored(top, "top-cycles")
    first = cycles.join(broadcast_if_small(top.select(*own)), own).withColumn("nth", F.row_number().over(W.partitionBy(*own).orderBy("node"))).where(F.col("nth") <= files)
    names = first.groupBy(*own).agg(F.array_sort(F.collect_list("node")).alias("files"))  # ``files`` at most
    return top.join(names, own).join(counts, "project").select(*own, "size", "files", "cycles", "rank")
