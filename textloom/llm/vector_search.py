"""Approximate nearest neighbours by adaptive dimension scan within inverted lists.

Vectors are put into lists by their nearest centroid: as many lists as the root of the number of different vectors, by k-means on a
sample of about ``FIT_ROWS`` of these, or ``FIT_SHARE`` a list where that is more; every vector is indexed. A query visits the lists of its nearest centroids, as
many as the sample shows to be needed. Within a list, vectors and query are turned
by one random rotation and compared block of columns by block of columns: after each block a candidate is abandoned if
its partial distance, taken as a sample of the whole, rejects the hypothesis that it is nearer than the best found so far.
Survivors are measured exactly, in double precision, on the original vectors.

Equal vectors are indexed once, with the ``k + 1`` smallest ids of their rows, repeats included: no more of them can be
among ``k`` nearest, as ties go to smaller ids. Lists, and the queries that visit a list, are dealt to tasks in chunks of bounded size, so a list with a
third of all rows is many tasks.

Defined cases: a vector that is null, zero, or has null or non-finite components, or whose id is null, takes no part;
vectors of different lengths aren't compared, each length is searched by itself (lengths are few); a row is a candidate
of every query but itself, other rows with its id or its vector included, and each row that asks is answered, rows equal in id and vector
alike; fewer candidates than ``k`` give fewer rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

FIT_ROWS = 20_000
FIT_SHARE = 4
#: Lists that a query visits: so many that this share of the nearest in the sample is in them, and at least so many.
FIT_RECALL = 0.97
MIN_PROBES = 16
FIT_QUERIES = 256
CHUNK = 4096
QUERY_CHUNK = 2048
#: Columns of a block, and the bound of the test in standard deviations of a partial distance.
BLOCK = 16
EPSILON = 2.1
SEED = 7


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles), its length n, and k1, k2, which name the vector: the rows that take part."""
    v = F.col(f"`{vector_col}`")
    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), v.cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    return rows.withColumns({"n": F.size("v"), "k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(SEED), "v")})


def kmeans(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Centroids of a sample held in memory."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest(sample, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest centers of each row, in no order."""
    out = np.empty((len(rows), k), np.int64)
    norms = (centers**2).sum(axis=1)
    for at in range(0, len(rows), 1024):
        far = norms - 2 * rows[at : at + 1024] @ centers.T
        out[at : at + 1024] = np.argmin(far, axis=1)[:, None] if k == 1 else np.argpartition(far, min(k, len(centers)) - 1, axis=1)[:, :k]
    return out


def probes_needed(sample: np.ndarray, centers: np.ndarray, k: int) -> int:
    """How many lists hold ``FIT_RECALL`` of the ``k`` nearest of sampled queries, measured against brute force in the sample."""
    sample = np.unique(sample, axis=0)
    asked = np.random.default_rng(SEED).permutation(len(sample))[:FIT_QUERIES]
    own, norms, ranks = nearest(sample, centers, 1)[:, 0], (sample**2).sum(axis=1), []
    for q in asked:
        far = norms - 2 * sample @ sample[q]
        near = np.argpartition(far, min(k, len(far) - 1))[: k + 1]
        place = np.empty(len(centers), np.int64)
        place[np.argsort(((centers - sample[q]) ** 2).sum(axis=1), kind="stable")] = np.arange(len(centers))
        ranks.append(place[own[near]])
    return min(len(centers), max(MIN_PROBES, 1 + int(np.quantile(np.concatenate(ranks), FIT_RECALL, method="higher"))))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def scan(query: np.ndarray, turned_query: np.ndarray, vectors: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the nearest found among ``vectors``: at least every one that the tests keep, at most about ``k`` and ties."""
    dim = len(query)
    places, best = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(vectors), 512):
        alive = np.arange(at, min(at + 512, len(vectors)))
        if len(best) >= k:
            limit = best[k - 1] ** 2
            part = np.zeros(len(alive))
            for d in range(0, dim, BLOCK):
                part += ((turned[alive, d : d + BLOCK] - turned_query[d : d + BLOCK]) ** 2).sum(axis=1)
                seen = min(d + BLOCK, dim)
                bound = limit * (1 + 1e-9) if seen == dim else limit * seen / dim * (1 + EPSILON / np.sqrt(seen)) ** 2
                keep = part <= bound
                alive, part = alive[keep], part[keep]
                if not len(alive):
                    break
        if len(alive):
            far = np.sqrt(((vectors[alive] - query) ** 2).sum(axis=1))
            places, best = np.r_[places, alive], np.r_[best, far]
            order = np.argsort(best, kind="stable")
            places, best = places[order], best[order]
            if len(best) > k:
                cut = np.searchsorted(best, best[k - 1], side="right")
                places, best = places[:cut], best[:cut]
    return places, best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(table: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found to each row that satisfies ``queries`` (SQL over vec_id)."""
    vectors = materialize(clean_vectors(table, id_col, vector_col), "vectors")
    found = None
    for n in sorted(r["n"] for r in vectors.select("n").distinct().collect()):
        one = _search_length(vectors.where(F.col("n") == n), queries, k)
        found = one if found is None else found.unionByName(one)
    return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _search_length(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = vectors.sparkSession
    least = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = vectors.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    classes = materialize(few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    total = classes.count()
    lists = max(1, round(np.sqrt(total)))
    share = max(FIT_ROWS, FIT_SHARE * lists) / total
    sample = classes if share >= 1 else classes.where(F.expr(f"(k2 & 9223372036854775807) < {int(share * (1 << 63))}"))
    sample = _matrix(sample.select("v").toPandas()["v"])
    centers = kmeans(sample, lists)
    probes = probes_needed(sample, centers, k)
    turn = rotation(sample.shape[1])
    shared = spark.sparkContext.broadcast((centers, turn))

    def assign(frames):
        centers, _ = shared.value
        for f in frames:
            if len(f):
                yield f.assign(list=nearest(_matrix(f["v"]), centers, 1)[:, 0].astype("int32"))

    indexed = materialize(classes.mapInPandas(assign, "k1 long, k2 long, v array<double>, ids array<long>, list int"), "index")

    def visit(frames):
        centers, _ = shared.value
        for f in frames:
            if len(f):
                yield f.assign(lists=list(nearest(_matrix(f["v"]), centers, probes).astype("int32")))

    asking = vectors.where(queries).groupBy(F.col("vec_id").alias("query_id"), "k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    asked = vectors.where(queries).dropDuplicates(["k1", "k2"]).select("k1", "k2", "v")
    visits = asked.mapInPandas(visit, "k1 long, k2 long, v array<double>, lists array<int>").select("k1", "k2", "v", F.explode("lists").alias("list"))
    visits = materialize(visits, "visits")
    sizes = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    crowds = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("turns"))
    plan = F.broadcast(sizes.join(crowds, "list"))
    members = indexed.join(plan, "list").select("list", F.expr("cast(pmod(k1, chunks) as int)").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "v", "ids", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    seekers = visits.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.expr("cast(pmod(k2, turns) as int)").alias("turn"), "k1", "k2", "v")

    def compare(members: pd.DataFrame, seekers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(seekers):
            _, turn = shared.value
            rows, asks = _matrix(members["v"]), _matrix(seekers["v"])
            turned, turned_asks = rows @ turn, asks @ turn
            ids, c1, c2 = (members[c].to_numpy() for c in ("ids", "c1", "c2"))
            for i, (a, b) in enumerate(zip(seekers["k1"], seekers["k2"])):
                for place, far in zip(*scan(asks[i], turned_asks[i], rows, turned, k + 1)):
                    out.append((a, b, c1[place], c2[place], ids[place], far))
        return pd.DataFrame(out, columns=["k1", "k2", "c1", "c2", "ids", "score"])

    key = ["list", "chunk", "turn"]
    found = members.groupBy(*key).cogroup(seekers.groupBy(*key)).applyInPandas(compare, "k1 long, k2 long, c1 long, c2 long, ids array<long>, score double")
    found = found.select("k1", "k2", "score", (F.col("c1").eqNullSafe(F.col("k1")) & F.col("c2").eqNullSafe(F.col("k2"))).alias("equal"), F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("k1", "k2").orderBy("score", "vec_id", F.desc("equal"))
    best = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
    mine = asking.join(best, ["k1", "k2"])
    # Of the rows with the query's id and vector, one is the query itself; what comes behind it moves up.
    own = F.min(F.when(F.col("equal") & (F.col("vec_id") == F.col("query_id")), F.col("place"))).over(Window.partitionBy("query_id", "k1", "k2"))
    own = F.coalesce(own, F.lit(k + 2))
    ranked = mine.withColumn("own", own).where("place <> own").withColumn("rank", F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0))
    ranked = ranked.where(F.col("rank") <= k).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return ranked.select("query_id", "rank", "vec_id", "score")
