"""Paths, components, communities and neighbourhoods of random graphs against plain searches, with hubs, guards and empty tables."""

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, paths


def graph_of(rng, nodes, links):
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]


def adjacent(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def least_path(near, a, b):
    """The path of least nodes among the shortest, by distances to b."""
    far, queue = {b: 0}, deque([b])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    if a not in far:
        return None
    path = [a]
    while path[-1] != b:
        path.append(min(y for y in near[path[-1]] if far.get(y) == far[path[-1]] - 1))
    return path


@pytest.mark.parametrize("nodes, links", [(60, 62), (12, 60)])
def test_paths(spark, nodes, links):
    rng = random.Random(nodes)
    edges = graph_of(rng, nodes, links) + [(100 + i, 101 + i) for i in range(9)]
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(60)] + [(100, 109), (100, 3), (7, 7), (500, 501)]
    table = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src long, dst long, edge_id long")
    found = {(r["src"], r["dst"]): r for r in paths.shortest_paths(spark.createDataFrame(pairs + pairs[:3], "src long, dst long"), table).collect()}
    near, ids = adjacent(edges), {}
    for i, (a, b) in reversed(list(enumerate(edges))):
        ids[a, b] = ids[b, a] = min(i, ids.get((a, b), i))
    for a, b in set(pairs):
        want = [a] if a == b else least_path(near, a, b)
        if want is None:
            assert (a, b) not in found
        else:
            row = found[a, b]
            assert row["path"] == ">".join(map(str, want)) and row["length"] == len(want) - 1
            assert row["edges"] == ",".join(str(ids[x, y]) for x, y in zip(want, want[1:]))


def test_paths_of_limited_depth(spark):
    table = spark.createDataFrame([(i, i + 1, i) for i in range(30)], "src long, dst long, edge_id long")
    pairs = spark.createDataFrame([(0, 20), (0, 21), (3, 5)], "src long, dst long")
    assert {(r["src"], r["dst"], r["length"]) for r in paths.shortest_paths(pairs, table).collect()} == {(0, 20, 20), (3, 5, 2)}
    assert {(r["dst"]) for r in paths.shortest_paths(pairs, table, 1).collect()} == set() and paths.shortest_paths(pairs, table.where("false")).count() == 0
    with pytest.raises(ValueError):
        paths.shortest_paths(pairs, table, 21)


@pytest.mark.parametrize("hubs_over", [2, 1 << 16])
def test_components(spark, hubs_over):
    rng = random.Random(9)
    edges = graph_of(rng, 80, 50) + [(200 + i, 201 + i) for i in range(70)] + [(90, i) for i in range(300, 360)] + [(5, 5), (999, 999)]
    near, root = adjacent(edges), {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = start
                stack += near[x]
    found = graph.connected_components(spark.createDataFrame(edges, "src long, dst long"), hubs_over)
    assert {r["node"]: r["component"] for r in found.collect()} == root
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_hub_is_dealt_to_all_tasks(spark):
    """The links of a star's middle stay where they are read: what is shuffled by node is the rest."""
    leaves = spark.range(1, 200_001, 1, 8).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    links = graph.both_ways(leaves)
    table = spark.createDataFrame([(0, 7)], "node long, m long").unionByName(leaves.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("m")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would make one task of so few bytes
    try:
        joined = graph.by_node(links, "a", table, graph.hubs_of(links, "a", 1000))
        sizes = joined.where("a = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 200_000 and max(r["count"] for r in sizes) < 200_000 / 2
    found = graph.connected_components(leaves, 1000)
    assert found.agg(F.count("*"), F.max("component")).first() == (200_001, 0)


@pytest.mark.parametrize("hubs_over", [2, 1 << 16])
def test_communities(spark, hubs_over):
    rng = random.Random(10)
    edges = graph_of(rng, 40, 70) + [(300, i) for i in range(301, 320)] + [(400, 401)]
    near = adjacent(edges)
    for rounds in (2, 9):
        labels = {x: x for x in near}
        for _ in range(rounds):
            new = {x: min(Counter(labels[y] for y in near[x]).items(), key=lambda v: (-v[1], v[0]))[0] for x in near}
            if new == labels:
                break
            labels = new
        found = graph.label_propagation(spark.createDataFrame(edges, "src long, dst long"), rounds, hubs_over)
        assert {r["node"]: r["label"] for r in found.collect()} == labels, rounds
    with pytest.raises(ValueError):
        graph.label_propagation(spark.createDataFrame(edges, "src long, dst long"), 101)


def test_neighbourhoods(spark):
    rows = [(1, 1, 2, None), (1, 2, 3, "2024-01-01"), (2, 1, 9, None), (1, 3, 4, None)]
    edges = spark.createDataFrame(rows, "user_id long, src long, dst long, invalid_at string")
    seeds = spark.createDataFrame([(1, 1)], "user_id long, node long")
    nodes = lambda **o: {r["node"]: r["depth"] for r in graph.bfs(seeds, edges, 3, **o).collect()}
    assert nodes() == {1: 0, 2: 1, 9: 1, 3: 2, 4: 3} and nodes(valid_only=True) == {1: 0, 2: 1, 9: 1} and nodes(same_user=True) == {1: 0, 2: 1, 3: 2, 4: 3}
    for depth, most in ((11, 5), (1, 501), (1, 0)):
        with pytest.raises(ValueError):
            graph.bfs(seeds, edges, depth, most)


@pytest.mark.parametrize("most", [3, 20, 500])
def test_neighbourhoods_read_no_more_of_a_hub_than_fits(spark, monkeypatch, most):
    """Reached nodes are the least ones of the nearest, and no table holds more of a node's neighbours than a seed may take."""
    rng, sizes, cut = random.Random(most), [], graph.cut
    pairs = graph_of(rng, 40, 90) + [(7, 1000 + i) for i in range(3000)]
    near = adjacent(pairs)

    def counted(df):
        sizes.append((out := cut(df)).select(F.max(F.size("near")) if "near" in out.columns else F.count("*")).first()[0])
        return out

    monkeypatch.setattr(graph, "cut", counted)
    table = spark.createDataFrame(pairs, "src long, dst long")
    found = graph.bfs(spark.range(12).withColumnRenamed("id", "node"), table, 3, most).collect()
    got = {(r["seed"], r["node"], r["depth"]) for r in found}
    want = set()
    for seed in range(12):
        seen, front = {seed}, [seed]
        want.add((seed, seed, 0))
        for hop in range(1, 4):
            front = sorted({y for x in front for y in near[x]} - seen)[: most - len(seen)]
            seen |= set(front)
            want |= {(seed, y, hop) for y in front}
    assert got == want and len(found) == len(want) and max(sizes) <= 12 * most


def test_induced_edges_of_a_node_that_all_seeds_reach(spark, monkeypatch):
    """300 seeds reach a hub of 3,000 links and three of its leaves: its links aren't made for each seed, and parts have a bounded number of rows."""
    asked, dealt = [], graph.dealt
    monkeypatch.setattr(graph, "ROWS", 500)
    monkeypatch.setattr(graph, "dealt", lambda df, rows, *keys: asked.append(rows) or dealt(df, rows, *keys))
    edges = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(1, 3000)] + [(5, 5), (9, 0), (0, 1), (1, 0)]
    reach = {s: {0, s, s + 1, s + 2} for s in range(1, 301)}
    reached = spark.createDataFrame([(s, x, 1) for s, nodes in reach.items() for x in nodes], "seed long, node long, depth int")
    found = graph.induced_edges(reached, spark.createDataFrame(edges, "src long, dst long"))
    want = {(s, a, b) for s, nodes in reach.items() for a, b in set(edges) if a in nodes and b in nodes}
    got = [(r["seed"], r["src"], r["dst"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and 0 < max(asked) < 2 * len(want)
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 1000 < len(want)
    assert graph.induced_edges(reached.where("false"), spark.createDataFrame(edges, "src long, dst long")).count() == 0


def test_pairs_of_one_end_share_its_search(spark, monkeypatch):
    """300 leaves of a hub look for one node two hops behind it: no table has more rows than there are links, both ways."""
    sizes, cut = [], paths.cut

    def counted(df):
        sizes.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(paths, "cut", counted)
    edges = spark.createDataFrame([(10 + i, 1, i) for i in range(400)] + [(1, 2, 900), (2, 3, 901)], "src long, dst long, edge_id long")
    found = paths.shortest_paths(edges.where("edge_id < 300").selectExpr("src", "3L AS dst"), edges).collect()
    assert {r["path"] for r in found} == {f"{10 + i}>1>2>3" for i in range(300)} and max(sizes) <= 2 * 402
