"""Shortest paths for tables of pairs, searched from their distinct ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import both_ways, cut

DEPTH = 20
_PAIR = ["src", "dst"]


def shortest_hops(pairs: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(src, dst, hop, node, next, edge_id): every hop of one shortest undirected path of each pair, of at most `depth` hops; hop 0 is the first.

    edges: src, dst and edge_id; of a hop's edges the least id is named. Of equally short paths it is the one of least nodes, from src on.
    Pairs without a path, and those of one node, have no hop.

    The search starts from the distinct ends dst, so that pairs of one end share it: each node that it reaches keeps the least node of those before it,
    which is the next one on the path of least nodes. The last hop is made from the other end: before a level is left, open pairs look for it among the
    neighbours of src, and ends without open pairs go no further. Then the pointers are followed from src to dst. No path is carried in a row before it is known.
    """
    if not 0 <= depth <= DEPTH:
        raise ValueError(f"depth must lie between 0 and {DEPTH}")
    links = cut(both_ways(edges))
    open_ = cut(pairs.select(*_PAIR).where("src is not null and dst is not null and src <> dst").distinct())
    level = cut(open_.select("dst", F.col("dst").alias("node"), F.lit(None).cast(dict(open_.dtypes)["dst"]).alias("next")).distinct())
    # levels[n]: (dst, node, next) of the nodes n hops from dst; firsts[n]: (src, dst, next) of the pairs n + 1 hops apart.
    levels, seen, firsts = [level], level.select("dst", "node"), []
    for hop in range(depth):
        beside = open_.join(links, open_["src"] == links["a"]).select(*_PAIR, F.col("b").alias("node"))
        firsts.append(cut(beside.join(level.select("dst", "node"), ["dst", "node"], "left_semi").groupBy(*_PAIR).agg(F.min("node").alias("next"))))
        open_ = cut(open_.join(firsts[-1].select(*_PAIR), _PAIR, "left_anti"))
        ends = open_.select("dst").distinct()
        if hop + 1 == depth or open_.isEmpty():
            break
        out = level.select("dst", "node").join(ends, "dst", "left_semi").withColumnRenamed("node", "from").join(links, F.col("from") == links["a"])
        level = cut(out.groupBy("dst", F.col("b").alias("node")).agg(F.min("from").alias("next")).join(seen, ["dst", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("dst", "node"))
    way = None
    for length, first in enumerate(firsts, 1):
        here = first.select(*_PAIR, F.lit(0).alias("hop"), F.col("src").alias("node"), "next")
        way = here if way is None else way.unionByName(here)
        for hop in range(1, length):
            here = cut(here.select(*_PAIR, F.lit(hop).alias("hop"), F.col("next").alias("node")).join(levels[length - hop], ["dst", "node"]).select(*_PAIR, "hop", "node", "next"))
            way = way.unionByName(here)
    if way is None:
        return open_.select(*_PAIR, F.lit(0).alias("hop"), F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(None).cast("long").alias("edge_id")).where("false")
    named = edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), "edge_id").groupBy("low", "high").agg(F.min("edge_id").alias("edge_id"))
    way = way.withColumns({"low": F.least("node", "next"), "high": F.greatest("node", "next")})
    return way.join(named, ["low", "high"]).select(*_PAIR, "hop", "node", "next", "edge_id")


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(src, dst, length, path, edges) of the pairs that a path joins: its nodes, and the ids of its edges, in order. The same node has length 0."""
    hops = shortest_hops(pairs, edges, depth)
    listed = F.array_sort(F.collect_list(F.struct("hop", "next", "edge_id")))
    text = lambda field: F.transform("hops", lambda h: h[field].cast("string"))
    found = hops.groupBy(*_PAIR).agg(listed.alias("hops"))
    found = found.select(*_PAIR, F.size("hops").alias("length"), F.concat_ws(">", F.col("src").cast("string"), text("next")).alias("path"), F.concat_ws(",", text("edge_id")).alias("edges"))
    same = pairs.select(*_PAIR).where("src = dst").distinct().select(*_PAIR, F.lit(0).alias("length"), F.col("src").cast("string").alias("path"), F.lit("").alias("edges"))
    return found.unionByName(same)
