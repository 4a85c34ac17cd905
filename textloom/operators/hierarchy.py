"""Trees of topics: linkage, reduction, text trees, cuts, merges of models.

Distances between topics are made in Spark; a tree is built over topics on the driver, whose number is checked, since a
linkage is sequential by nature. What follows a tree, such as the words of each merge, is a plan over (step, leaf) again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..plans.tables import cut as written
from . import ctfidf, similarity

#: Topics that a tree is built over.
MAX_TOPICS = 5000


def topic_distances(centers: DataFrame) -> tuple[list[int], np.ndarray]:
    """Topics in order and the matrix of 1 - cosine between their vectors."""
    if centers.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    rows = centers.select("topic", v.doubles(F.col("vector")).alias("v")).orderBy("topic").collect()
    x = np.array([r["v"] for r in rows])
    n = np.linalg.norm(x, axis=1)
    x = x / np.where(n == 0, 1, n)[:, None]
    d = np.round(1 - x @ x.T, 12)
    np.fill_diagonal(d, 0)
    return [r["topic"] for r in rows], np.maximum(d, 0)


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of each merge by Lance-Williams updates; new clusters are numbered on from n. Ties: smaller numbers first."""
    n = len(d)
    dist = np.full((2 * n - 1, 2 * n - 1), np.inf)
    dist[:n, :n] = d
    np.fill_diagonal(dist, np.inf)
    sizes, alive, out = {i: 1 for i in range(n)}, list(range(n)), []
    for new in range(n, 2 * n - 1):
        sub = dist[np.ix_(alive, alive)]
        at = int(np.argmin(sub))
        i, j = sorted((alive[at // len(alive)], alive[at % len(alive)]))
        h = dist[i, j]
        rest = [k for k in alive if k not in (i, j)]
        a, b = sizes[i], sizes[j]
        for k in rest:
            if method == "average":
                x = (a * dist[i, k] + b * dist[j, k]) / (a + b)
            elif method == "ward":
                c = sizes[k]
                x = np.sqrt(max(0.0, ((a + c) * dist[i, k] ** 2 + (b + c) * dist[j, k] ** 2 - c * h**2) / (a + b + c)))
            elif method == "single":
                x = min(dist[i, k], dist[j, k])
            elif method == "complete":
                x = max(dist[i, k], dist[j, k])
            else:
                raise ValueError(f"unknown method {method!r}")
            dist[new, k] = dist[k, new] = x
        sizes[new] = a + b
        alive = [*rest, new]
        out.append((i, j, float(h), a + b))
    return out


def spread_ties(heights: list[float], step: float = 1e-9) -> list[float]:
    """Rising heights where equal ones differ by a fixed small step."""
    out = []
    for h in heights:
        out.append(h if not out or h > out[-1] else out[-1] + step)
    return out


def cut(links: list[tuple[int, int, float, int]], n: int, groups: int) -> list[int]:
    """The group of each leaf when merges stop at ``groups``; groups are numbered by their first leaf."""
    parent = list(range(2 * n - 1))
    for k, (i, j, _, _) in enumerate(links[: max(0, n - groups)]):
        parent[i] = parent[j] = n + k

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    names: dict[int, int] = {}
    return [names.setdefault(top(x), len(names)) for x in range(n)]


def reduction_mapping(spark: SparkSession, centers: DataFrame, groups: int, method: str = "average") -> DataFrame:
    """from_topic, to_topic: topics put into at most ``groups``, each named by its smallest topic."""
    topics, d = topic_distances(centers)
    found = cut(linkage(d, method), len(topics), groups)
    first: dict[int, int] = {}
    rows = [(int(t), int(first.setdefault(g, t))) for t, g in zip(topics, found)]
    return spark.createDataFrame(rows, "from_topic long, to_topic long")


def tree(spark: SparkSession, centers: DataFrame, method: str = "ward") -> DataFrame:
    """step, parent, left, right, distance, topics (leaves below): a row for each merge. Leaves keep their topic; parents follow the largest topic."""
    topics, d = topic_distances(centers)
    links = linkage(d, method)
    base, n = max(topics, default=0) + 1, len(topics)
    name = lambda k: int(topics[k]) if k < n else base + k - n
    below = {k: [int(t)] for k, t in enumerate(topics)}
    rows = []
    for k, ((i, j, _, _), h) in enumerate(zip(links, spread_ties([x[2] for x in links]))):
        below[n + k] = sorted(below[i] + below[j])
        rows.append((k, base + k, name(i), name(j), float(h), below[n + k]))
    return spark.createDataFrame(rows, "step long, parent long, left long, right long, distance double, topics array<long>")


def name_parents(merges: DataFrame, bow: DataFrame, idf: DataFrame, n: int = 5) -> DataFrame:
    """step, name: the ``n`` best words of each merge's topics together, scored with the fitted idf. One aggregation for all merges."""
    leaves = merges.select("step", F.explode("topics").alias("topic"))
    counts = bow.join(leaves, "topic").groupBy("step", "term").agg(F.sum("n").alias("n"))
    sizes = counts.groupBy("step").agg(F.sum("n").alias("size"))
    scored = counts.join(idf, "term").join(sizes, "step").withColumn("score", F.col("n") / F.col("size") * F.col("idf"))
    top = ctfidf.top_words(scored, n, by="step").groupBy("step").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("r"))
    return top.select("step", F.array_join(F.transform("r", lambda x: x["term"]), "_").alias("name"))


def ancestors(merges: DataFrame, level: float) -> DataFrame:
    """topic, ancestor: the largest merge no higher than ``level`` that holds each topic; itself without one."""
    each = merges.select(F.explode("topics").alias("topic"), "parent", "distance", F.size("topics").alias("n"))
    low = each.where(F.col("distance") <= level).groupBy("topic").agg(F.max(F.struct("n", "parent"))["parent"].alias("parent"))
    return each.select("topic").distinct().join(low, "topic", "left").select("topic", F.coalesce("parent", "topic").alias("ancestor"))


def text_tree(merges: DataFrame, names: dict[int, str] | None = None) -> str:
    """The tree as indented text. Small by the limit on topics."""
    rows = {r["parent"]: r for r in merges.collect()}
    names = names or {}
    if not rows:
        return ""
    out: list[str] = []

    def show(node: int, depth: int) -> None:
        r = rows.get(node)
        out.append("    " * depth + (f"+-- {names.get(node, node)}" if r is not None else f"*-- topic {names.get(node, node)}"))
        if r is not None:
            show(r["left"], depth + 1)
            show(r["right"], depth + 1)

    show(max(rows), 0)
    return "\n".join(out)


def merge_all(models: list[tuple[DataFrame, DataFrame]], least: float = 0.7) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(vectors, sizes, mappings) of models folded into the first, one after another; each is (vectors, sizes: topic, size). Sizes of topics that become one are added up."""
    vectors, sizes = models[0]
    mappings = [vectors.select(F.col("topic").alias("from_topic"), F.col("topic").alias("to_topic"))]
    for more, counts in models[1:]:
        vectors, mapping = merge_models(vectors, more, least)
        vectors, mapping = written(vectors), written(mapping)
        moved = counts.join(mapping, F.col("topic") == F.col("from_topic")).select(F.col("to_topic").alias("topic"), "size")
        sizes = written(sizes.select("topic", "size").unionByName(moved).groupBy("topic").agg(F.sum("size").alias("size")))
        mappings.append(mapping)
    return vectors, sizes, mappings


def auto_mapping(centers: DataFrame, min_size: int = 2) -> DataFrame:
    """from_topic, to_topic: topics whose vectors, scaled to length one, lie densely together become the smallest of them; the rest stay."""
    from . import clusters

    unit = centers.where("topic <> -1").select("topic", v.scaled(v.doubles(F.col("vector"))).alias("vector"))
    found = written(clusters.density_clusters(unit, "topic", "vector", min_size))
    first = found.where("cluster >= 0").groupBy("cluster").agg(F.min("topic").alias("to_topic"))
    joined = found.join(first, "cluster", "left")
    return joined.select(F.col("topic").alias("from_topic"), F.coalesce("to_topic", "topic").alias("to_topic"))


def merge_models(first: DataFrame, second: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(merged vectors, mapping of the second's topics): topics of the second that are like one of the first become it, others are added behind."""
    from pyspark.sql import Window

    near = similarity.nearest(second.withColumnRenamed("topic", "from_topic"), first, threshold=least)
    base = F.broadcast(first.agg((F.max("topic") + 1).alias("base")))  # one row
    fresh = near.where("topic = -1").withColumn("k", F.row_number().over(Window.orderBy("from_topic")) - 1).crossJoin(base)
    added = fresh.select("from_topic", (F.col("base") + F.col("k")).cast("long").alias("to_topic"), "vector")
    mapping = near.where("topic <> -1").select("from_topic", F.col("topic").alias("to_topic")).unionByName(added.select("from_topic", "to_topic"))
    vectors = first.select("topic", "vector").unionByName(added.select(F.col("to_topic").alias("topic"), "vector"))
    return vectors, mapping
