"""Clusters: fitting, rescue of noise, filtering, quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..plans.tables import counted, cut, ranked
from . import pairwise, similarity

NOISE = -1
#: Points of which a density clustering is fitted in one process; of more, distances are taken block against block on the cluster.
FIT_POINTS = 8000


def kmeans(rows: DataFrame, k: int, vector: str = "vector", seed: int = 42) -> DataFrame:
    """``rows`` with ``cluster`` from k-means on the cluster's executors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("__v", array_to_vector(v.doubles(F.col(vector))))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("__v")


def pca(rows: DataFrame, k: int = 5, vector: str = "vector", out: str = "reduced") -> DataFrame:
    """``rows`` with the first ``k`` principal components of the vectors, signs made positive at the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumn("__v", array_to_vector(v.doubles(F.col(vector))))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(data)
    loads = model.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), range(k)])
    array = F.zip_with(vector_to_array("__p"), F.array(*[F.lit(float(s)) for s in signs]), lambda x, s: x * s)
    return model.transform(data).withColumn(out, array).drop("__v", "__p")


def density_labels(points: np.ndarray, min_size: int = 10, min_samples: int | None = None) -> np.ndarray:
    """Labels of a hierarchical density clustering (excess of mass) of points in memory; -1 is noise.

    Mutual-reachability distances give a spanning tree (Prim's, no distance matrix kept); its edges by rising length merge
    points into a tree, which is condensed by ``min_size``; clusters are chosen by stability from the leaves up.
    """
    n = len(points)
    if n < 2 * min_size:
        return np.full(n, NOISE)
    k = min(min_samples or min_size, n - 1)
    norms = (points**2).sum(axis=1)
    row = lambda i: np.sqrt(np.maximum(norms + norms[i] - 2 * points @ points[i], 0))
    core = np.array([np.partition(row(i), k)[k] for i in range(n)])
    best, source, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(row(at), core), core[at])
        closer = ~done & (reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((best[at], source[at], at))
    return _labels_of_tree(n, edges, min_size)


def _labels_of_tree(n: int, edges: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    """Labels from the (length, point, point) of a spanning tree."""
    edges = sorted(edges, key=lambda e: e[0])
    parent, size, node = list(range(2 * n - 1)), [1] * (2 * n - 1), n
    kids: dict[int, tuple[int, int, float]] = {}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, a, b in edges:
        x, y = top(a), top(b)
        parent[x] = parent[y] = node
        size[node], kids[node] = size[x] + size[y], (x, y, d)
        node += 1

    def leaves(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += kids[j][:2]
        return out

    # Condense: (cluster, its birth, its points' exits, its children).
    clusters = [{"birth": 0.0, "mass": 0.0, "points": [], "kids": []}]
    todo = [(2 * n - 2, 0)]
    while todo:
        i, c = todo.pop()
        if i < n:
            clusters[c]["points"].append(i)
            continue
        x, y, d = kids[i]
        lam = 1 / max(d, 1e-12)
        big = [z for z in (x, y) if size[z] >= min_size]
        if len(big) == 2:
            clusters[c]["mass"] += size[i] * (lam - clusters[c]["birth"])
            for z in big:
                clusters.append({"birth": lam, "mass": 0.0, "points": [], "kids": []})
                clusters[c]["kids"].append(len(clusters) - 1)
                todo.append((z, len(clusters) - 1))
            continue
        for z in (x, y):
            if z in big:
                todo.append((z, c))
            else:
                found = leaves(z)
                clusters[c]["points"] += found
                clusters[c]["mass"] += len(found) * (lam - clusters[c]["birth"])
    chosen = [False] * len(clusters)
    value = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(value[k] for k in clusters[c]["kids"])
        chosen[c] = c > 0 and clusters[c]["mass"] >= below
        value[c] = clusters[c]["mass"] if chosen[c] else below
    labels, number = np.full(n, NOISE), 0

    def everything(c: int) -> list[int]:
        out = list(clusters[c]["points"])
        for k in clusters[c]["kids"]:
            out += everything(k)
        return out

    todo = [0]
    while todo:
        c = todo.pop()
        if chosen[c]:
            labels[everything(c)] = number
            number += 1
        else:
            todo += reversed(clusters[c]["kids"])
    return labels


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    far = x @ y.T
    far *= -2
    far += (x**2).sum(axis=1)[:, None]
    far += (y**2).sum(axis=1)
    return np.sqrt(np.maximum(far, 0, out=far), out=far)


def _core_distances(rows: DataFrame, k: int, blocks: int) -> DataFrame:
    """id, core: the distance of each row to its ``k``-th neighbour among all rows."""

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "near": []})
        far = _distances(np.stack(a["v"]), np.stack(b["v"]))
        far[a["id"].to_numpy()[:, None] == b["id"].to_numpy()] = 0.0
        m = min(k, far.shape[1] - 1)
        return pd.DataFrame({"id": a["id"].to_numpy(), "near": list(np.partition(far, m, axis=1)[:, : m + 1])})

    parts = pairwise._pairs(rows, blocks, "id", True).groupBy("i", "j").applyInPandas(nearest, "id long, near array<double>")
    return parts.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near")))[k].alias("core"))


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges of a smallest spanning forest (Kruskal's)."""
    names, ends = np.unique(np.r_[a, b], return_inverse=True)
    ends = ends.reshape(2, -1)
    parent, kept = list(range(len(names))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for e in np.lexsort((b, a, d)).tolist():
        x, y = top(int(ends[0, e])), top(int(ends[1, e]))
        if x != y:
            parent[x] = y
            kept.append(e)
    return np.array(kept, int)


def _spanning_edges(rows: DataFrame, k: int, n: int) -> pd.DataFrame:
    """a, b, d: a smallest spanning tree of all rows by mutual reachability. An edge that no tree of two blocks needs isn't needed by that of all."""
    blocks = max(1, -(-n // pairwise.BLOCK_ROWS))
    cored = cut(rows.join(_core_distances(rows, k, blocks), "id"))

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, core = pdf["id"].to_numpy(), pdf["core"].to_numpy()
        x = np.stack(pdf["v"])
        far = _distances(x, x)
        np.maximum(far, core, out=far)
        np.maximum(far, core[:, None], out=far)
        best, source, at, edges = np.full(len(x), np.inf), np.zeros(len(x), int), 0, []
        done = np.zeros(len(x), bool)
        for _ in range(len(x) - 1):
            done[at] = True
            closer = far[at] < best
            best[closer], source[closer] = far[at][closer], at
            at = int(np.argmin(np.where(done, np.inf, best)))
            edges.append((ids[source[at]], ids[at], best[at]))
        return pd.DataFrame(edges, columns=["a", "b", "d"])

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[["a", "b", "d"]]
        return pdf.iloc[_forest(*(pdf[c].to_numpy() for c in "abd"))]

    edges = cut(pairwise._pairs(cored, blocks, "id", False).groupBy("i", "j").applyInPandas(span, "a long, b long, d double"))
    while (m := edges.count()) > 4 * n:
        groups = -(-m // (4 * n))
        edges = cut(edges.withColumn("g", F.pmod(F.xxhash64("a", "b"), F.lit(groups))).groupBy("g").applyInPandas(thin, "a long, b long, d double"))
    return thin(edges.toPandas())


def density_clusters(rows: DataFrame, key: str = "id", vector: str = "vector", min_size: int = 10, fit_points: int = FIT_POINTS) -> DataFrame:
    """key, cluster: density clusters of all rows. Up to ``fit_points`` rows are clustered in one process; of more, core
    distances and the spanning tree are made block against block on the cluster, and the driver gets the tree's edges."""
    spark = rows.sparkSession
    total = rows.count()
    rows = rows.select(key, v.doubles(F.col(vector)).alias("v"))
    if total <= fit_points:
        pdf = rows.toPandas().sort_values(key)
        if pdf.empty:
            return rows.select(key, F.lit(NOISE).alias("cluster"))
        pdf["cluster"] = density_labels(np.stack(pdf["v"]), min_size)
        return spark.createDataFrame(pdf[[key, "cluster"]])
    if total < 2 * min_size:
        return rows.select(key, F.lit(NOISE).cast("long").alias("cluster"))
    numbered = cut(ranked(rows, key, name="__id"))
    tree = _spanning_edges(numbered.select(F.col("__id").alias("id"), "v"), min(min_size, total - 1), total)
    labels = _labels_of_tree(total, list(zip(tree["d"].tolist(), tree["a"].tolist(), tree["b"].tolist())), min_size)
    found = spark.createDataFrame(pd.DataFrame({"__id": np.arange(total), "cluster": labels.astype(np.int64)}))
    return numbered.select(key, "__id").join(found, "__id").select(key, "cluster")


def rescue_by_similarity(rows: DataFrame, cluster: str = "cluster", vector: str = "vector", threshold: float = 0.7) -> DataFrame:
    """``rows`` whose noise joined the cluster of the most similar centroid, where similar enough; ``rescued`` tells which."""
    centers = v.mean_vectors(rows.where(F.col(cluster) != NOISE), cluster, vector).withColumnRenamed(cluster, "topic")
    noise = similarity.nearest(rows.where(F.col(cluster) == NOISE), centers, vector, threshold=threshold)
    moved = noise.withColumn("rescued", F.col("topic") != NOISE).withColumn(cluster, F.col("topic")).drop("topic", "similarity")
    return rows.where(F.col(cluster) != NOISE).withColumn("rescued", F.lit(False)).unionByName(moved)


def rescue_by_strength(rows: DataFrame, strengths: DataFrame, key: str = "id", cluster: str = "cluster", threshold: float = 0.3, attempts: int = 1000) -> DataFrame:
    """The first ``attempts`` noise rows by key take their strongest cluster if its strength exceeds the threshold. The limit is the feature."""
    tried = rows.where(F.col(cluster) == NOISE).orderBy(key).limit(attempts).select(key)
    best = strengths.join(tried, key, "left_semi").groupBy(key).agg(F.max(F.struct("strength", (-F.col("topic")).alias("n"))).alias("b"))
    best = best.where(F.col("b.strength") > threshold).select(key, (-F.col("b.n")).alias("__to"))
    return rows.join(best, key, "left").withColumn(cluster, F.coalesce("__to", cluster)).drop("__to")


def filter_and_remap(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """``rows`` with clusters numbered from 0 by rising number; noise, and clusters with nothing but NA labels, become null."""
    real = rows.where(F.col(cluster) != NOISE).groupBy(cluster).agg(F.bool_and(F.lower(label) == "na").alias("na")).where(~F.col("na"))
    to = F.row_number().over(Window.orderBy(cluster)) - 1
    mapping = real.select(F.col(cluster).alias("__from"), to.cast("long").alias("__to"))
    return rows.join(mapping, F.col(cluster) == F.col("__from"), "left").withColumn(cluster, F.col("__to")).drop("__from", "__to")


def quality(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """noise_ratio, coverage, clusters, mean_size, size_variance: one row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(cluster) == NOISE).alias("noise"))
    sizes = rows.where(F.col(cluster) != NOISE).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    of_sizes = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.var_pop("n"), F.lit(0.0)).alias("size_variance"))
    noise = F.when(F.col("total") > 0, F.col("noise") / F.col("total")).otherwise(0.0)
    return total.join(of_sizes).select(noise.alias("noise_ratio"), (1 - noise).alias("coverage"), "clusters", "mean_size", "size_variance")


def memberships(rows: DataFrame, centers: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, topic, probability: each row's share in each cluster, by the inverse of its distance to the cluster's centre; a row on a centre is wholly its. Rows times clusters, the long form of a matrix."""
    c = counted(centers.select("topic", v.doubles(F.col("vector")).alias("__c")))
    far = F.sqrt(F.aggregate(F.zip_with(v.doubles(F.col(vector)), "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    each = rows.select(key, vector).crossJoin(c).select(key, "topic", far.alias("far"))
    least = F.min("far").over(Window.partitionBy(key))
    weight = F.when(least == 0, (F.col("far") == 0).cast("double")).otherwise(1 / F.col("far"))
    return each.withColumn("w", weight).select(key, "topic", (F.col("w") / F.sum("w").over(Window.partitionBy(key))).alias("probability"))


def strength(members: DataFrame, key: str) -> DataFrame:
    """key, topic, probability: each row's strongest cluster."""
    return members.groupBy(key).agg(F.max(F.struct("probability", (-F.col("topic")).alias("n"))).alias("b")).select(key, (-F.col("b.n")).alias("topic"), F.col("b.probability").alias("probability"))


def quality_score(silhouette, coverage, noise):
    return 0.4 * (silhouette + 1) / 2 + 0.3 * coverage + 0.3 * (1 - noise)


def representatives(rows: DataFrame, cluster: str, text: str, vector: str, n: int = 5, digits: int = 9) -> DataFrame:
    """cluster, rank, text, similarity: the ``n`` distinct texts nearest to their cluster's centroid."""
    centers = v.mean_vectors(rows, cluster, vector).withColumnRenamed("vector", "__c")
    scored = rows.join(centers, cluster).withColumn("similarity", F.round(v.cosine(v.doubles(F.col(vector)), F.col("__c")), digits))
    once = scored.groupBy(cluster, text).agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy(cluster).orderBy(F.desc("similarity"), text)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def mmr_order(document: np.ndarray, words: np.ndarray, diversity: float, n: int) -> list[int]:
    """Places of words chosen one by one: near to the document, far from those chosen."""
    unit = lambda x: x / np.where((s := np.linalg.norm(x, axis=-1, keepdims=True)) == 0, 1, s)
    d, w = unit(document), unit(words)
    near, among = w @ d, w @ w.T
    chosen = [int(np.argmax(near))]
    while len(chosen) < min(n, len(words)):
        rest = [i for i in range(len(words)) if i not in chosen]
        score = (1 - diversity) * near[rest] - diversity * among[np.ix_(rest, chosen)].max(axis=1)
        chosen.append(rest[int(np.argmax(score))])
    return chosen


def mmr(rows: DataFrame, topic: str, item: str, vector: str, centers: DataFrame, diversity: float = 0.1, n: int = 10) -> DataFrame:
    """topic, rank, item: a diverse choice of each topic's candidates, which are a bounded number of rows a topic."""
    joined = rows.join(centers.select(topic, F.col("vector").alias("__c")), topic)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        order = mmr_order(np.array(pdf["__c"].iloc[0]), np.stack(pdf[vector]), diversity, n)
        return pd.DataFrame({topic: pdf[topic].iloc[0], "rank": range(1, len(order) + 1), item: pdf[item].to_numpy()[order]})

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.withColumn(vector, v.doubles(F.col(vector))).groupBy(topic).applyInPandas(choose, f"{topic} {fields[topic]}, rank long, {item} {fields[item]}")
