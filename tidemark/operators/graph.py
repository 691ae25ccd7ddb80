"""Graph traversal by frontier joins; the driver holds no vertex."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the session names: it is computed once, no lost executor costs it, and its size is known to what reads it."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Nodes of more links than this are hubs; there are at most two edges for HUB times their number, so a table of them may be broadcast.
HUB = 1 << 16
#: Links of one folder, about, and folders at most.
FOLDER, MOST_FOLDERS = 2_000_000, 4096
#: Rows of one task, about, where they are dealt by their number.
ROWS = 1 << 20
#: What one call may ask for.
MOST_HOPS, MOST_NODES = 10, 500


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in parts of ROWS rows, about, of `rows` in all: bytes of a shuffle are no measure, as ids shrink to a tenth there of what they take in a task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): every link, once from each of its ends."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return both_ways(edges).toDF("src", "dst")


def hubs_of(links: DataFrame, key: str, most: int = HUB) -> DataFrame:
    """The nodes of more than `most` rows: at most a `most`-th of the rows."""
    return links.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("node")


def by_node(rows: DataFrame, key: str, table: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows joined with table (node, ...) on rows[key] = node. Rows of hubs meet a broadcast of the hubs' rows of table, so that no hub is a task's whole work."""
    few = F.broadcast(hubs)
    hot = rows.join(F.broadcast(table.join(few, "node", "left_semi")), rows[key] == F.col("node")).drop("node")
    rest = rows.join(few.withColumnRenamed("node", key), key, "left_anti")
    return hot.unionByName(rest.join(table, rest[key] == F.col("node")).drop("node").select(*hot.columns))


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, max_nodes: int = MOST_NODES, valid_only: bool = False, same_user: bool = False) -> DataFrame:
    """(seed, node, depth) within so many undirected hops of each seed, nearest first, max_nodes of each seed at most; of equal depth the least nodes.

    valid_only: edges that have been closed (invalid_at) are no way. same_user: seeds and edges have user_id, which the result has too, and a seed
    walks on its user's edges alone.
    """
    if not 0 <= depth <= MOST_HOPS or not 1 <= max_nodes <= MOST_NODES:
        raise ValueError(f"depth must lie between 0 and {MOST_HOPS}, max_nodes between 1 and {MOST_NODES}")
    own = ["user_id"] if same_user else []
    edges = edges.where("invalid_at is null") if valid_only else edges
    turned = edges.select(*own, F.col("dst").alias("src"), F.col("src").alias("dst"))
    # A seed takes max_nodes at most, those that it has seen included, so of each node's neighbours the least max_nodes suffice.
    place = F.row_number().over(W.partitionBy(*own, "src").orderBy("dst"))
    every = dealt(edges.select(*own, "src", "dst").union(turned), 2 * edges.count(), *own, "src", "dst")
    links = every.distinct().withColumn("place", place).where(F.col("place") <= max_nodes)
    near = cut(links.groupBy(*own, "src").agg(F.sort_array(F.collect_list(F.struct("dst"))).alias("near")))
    seen = cut(seeds.select(*own, F.col("node").alias("seed"), "node", F.lit(0).alias("depth")))
    frontier, key = seen, [*own, "seed"]
    for hop in range(1, depth + 1):
        room = cut(seen.groupBy(*key).agg((F.lit(max_nodes) - F.count("*")).cast("int").alias("room"), F.count_if(F.col("depth") == hop - 1).alias("wide")).where("room > 0 and wide > 0"))
        # First as many of each node's neighbours as should fill the room; the last of those that are new bounds what else is needed.
        tries = frontier.join(room, key).withColumnRenamed("node", "src").select(*own, "src", "seed", "room", (F.lit(8) + F.ceil(F.lit(4 * max_nodes) / F.col("wide"))).cast("int").alias("first"))
        fresh = lambda rows: rows.select(*key, "room", "node").distinct().join(seen.select(*key, "node"), [*key, "node"], "left_anti")  # noqa: B023, E731
        rank = F.row_number().over(W.partitionBy(*key).orderBy("node"))
        rows = room.agg(F.sum(9 * F.col("wide") + 4 * max_nodes)).first()[0] or 0
        steps = tries.join(near, [*own, "src"]).select(*key, "room", F.explode(F.slice("near", 1, F.col("first"))).alias("step")).withColumn("node", F.col("step.dst"))
        some = cut(fresh(dealt(steps, rows, *key, "node")).withColumn("rank", rank).where("rank <= room"))
        bound = some.where("rank = room").select(*key, F.struct(F.col("node").alias("dst")).alias("bound"))
        more = tries.join(bound, key, "left").join(near.where(F.size("near") > 8), [*own, "src"]).where(F.size("near") > F.col("first"))
        more = more.where(F.col("bound").isNull() | (F.col("near")[F.col("first")] < F.col("bound")))
        rest = F.filter(F.slice("near", F.col("first") + 1, max_nodes), lambda x: F.col("bound").isNull() | (x < F.col("bound")))
        more = fresh(more.select(*key, "room", F.explode(rest).alias("step")).withColumn("node", F.col("step.dst")))
        every = some.drop("rank").unionByName(more.select(*some.drop("rank").columns)).distinct()
        frontier = cut(every.withColumn("rank", rank).where("rank <= room").select(*key, "node", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def induced_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, src, dst): the edges, each once, of which a seed reached both ends.

    An edge meets the seeds of that end which fewer seeds reached, and each of them is asked whether it reached the other end too. So a node
    that all seeds reach is asked for, and its edges are not made for every seed.
    """
    ends = cut(reached.select("seed", "node"))
    seeds = cut(ends.groupBy("node").agg(F.count("*").alias("n")))
    of = lambda end: seeds.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"))
    both = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").distinct()
    by_src = F.col("src_n") <= F.col("dst_n")
    links = cut(both.select("src", "dst", F.when(by_src, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(by_src, F.col("dst")).otherwise(F.col("src")).alias("other"), F.least("src_n", "dst_n").alias("n")))
    asking = ends.join(links.select("node").distinct(), "node", "left_semi")
    tries = links.drop("n").join(asking.hint("merge"), "node").select("seed", "src", "dst", "other")
    rows = (links.agg(F.sum("n")).first()[0] or 0) + ends.count()
    reach = ends.withColumnRenamed("node", "other")
    return dealt(tries, rows, "seed", "other").join(dealt(reach, rows, "seed", "other").hint("merge"), ["seed", "other"]).select("seed", "src", "dst")


def _least(links: DataFrame, hubs_over: int) -> DataFrame:
    """Links (a, b) with m: the least of a and of all that it is linked with."""
    least = cut(links.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "b").alias("m"), "n"))
    return by_node(links, "a", least.select("node", "m"), least.where(F.col("n") > hubs_over).select("node"))


def connected_components(edges: DataFrame, hubs_over: int = HUB) -> DataFrame:
    """(node, component): least node that can be reached.

    Large-star: each node links its larger neighbours with the least of its neighbourhood. Small-star: it does so with its
    smaller ones and itself. The two take turns until nothing changes; what is left are stars around the least nodes. Links never get more than
    nodes and links together, and a hub's are dealt to all tasks, since its least neighbour is broadcast.
    """
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).where("node is not null").distinct())
    # Each link once, from its larger end.
    star = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    star, before = cut(star), None
    while True:
        every = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_least(every, hubs_over).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = _least(large, hubs_over)
        star = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).first()
        if state == before:
            return nodes.join(star.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = state


class _Buckets:
    """A table in folders by the hash of its nodes; of each folder the last version counts, so that a round rewrites only what it has touched."""

    def __init__(self, rows: DataFrame, name: str, count: int) -> None:
        self.spark, self.schema, self.count = rows.sparkSession, rows.schema, count
        self.root = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.version, self.at = 0, {}
        self.put(rows, list(range(count)))

    def place(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame, column: str = "node") -> list[int]:
        """The folders of these nodes: at most as many numbers as there are folders."""
        return sorted(r[0] for r in rows.select(self.place(column).alias("b")).distinct().collect())

    def put(self, rows: DataFrame, buckets: list[int]) -> None:
        """rows are all that these folders hold from now on."""
        self.version += 1
        path = f"{self.root}/version={self.version}"
        rows.withColumn("bucket", self.place("node")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        there = {r[0] for r in self.spark.read.schema("bucket int").option("basePath", path).parquet(path).distinct().collect()}
        self.at |= {b: f"{path}/bucket={b}" if b in there else None for b in buckets}

    def get(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in self.at.items() if p and (buckets is None or b in buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def label_propagation(edges: DataFrame, rounds: int = 20, hubs_over: int = HUB) -> DataFrame:
    """Synchronous majority labels in up to 100 rounds; ties go to the least label. Stops early once nothing changes.

    How many neighbours of a node have each label is kept, and a round brings only differences: a node that changed takes one from its neighbours'
    count of the old label and gives one to that of the new. Only nodes whose counts have changed vote again, and only the folders that hold them, and the
    links of what changed, are read and written.
    """
    if not 0 <= rounds <= 100:
        raise ValueError("rounds must lie between 0 and 100")
    whole = cut(both_ways(edges))
    hubs = cut(hubs_of(whole, "a", hubs_over))
    folders = min(MOST_FOLDERS, max(8, whole.count() // FOLDER))
    links = _Buckets(whole.select(F.col("a").alias("node"), "b"), "links", folders)
    counts = _Buckets(whole.select(F.col("a").alias("node"), F.col("b").alias("label"), F.lit(1).cast("long").alias("n")), "counts", folders)
    labels = _Buckets(whole.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels", folders)
    voters = None
    for number in range(rounds):
        buckets = None if voters is None else counts.touched(voters)
        votes = counts.get(buckets) if voters is None else counts.get(buckets).join(voters, "node", "left_semi")
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("new"))
        held = labels.get(buckets)
        changed = cut(held.join(best, "node").where("new <> label").select("node", F.col("label").alias("old"), "new"))
        if changed.isEmpty():
            break
        moved = labels.touched(changed)
        labels.put(labels.get(moved).join(changed.drop("old"), "node", "left").select("node", F.coalesce("new", "label").alias("label")), moved)
        if number + 1 == rounds:
            break
        near = by_node(links.get(moved).withColumnRenamed("node", "a"), "a", changed, hubs)
        change = lambda label, by: near.select(F.col("b").alias("node"), F.col(label).alias("label"), F.lit(by).cast("long").alias("n"))  # noqa: B023, E731
        deltas = cut(change("old", -1).unionByName(change("new", 1)).groupBy("node", "label").agg(F.sum("n").alias("n")).where("n <> 0"))
        voters = deltas.select("node").distinct()
        hit = counts.touched(deltas)
        counts.put(counts.get(hit).unionByName(deltas).groupBy("node", "label").agg(F.sum("n").alias("n")).where("n > 0"), hit)
    return labels.get()


def community_sizes(labels: DataFrame) -> DataFrame:
    """(label, node, members): each member of each community, with the community's size."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    return labels.join(sizes, "label").select("label", "node", "members")
