"""Retrieval over vectors: normalizing, reducing, exact search, quality."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
CUTS = (1, 5, 10, 20)


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order of the components."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; vectors shorter than the epsilon are divided by it."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(EPSILON))
    return F.transform(v.cast("array<double>"), lambda x: x / norm)


def prefix(v: Column, dims: int) -> Column:
    """The first ``dims`` components; fewer are an error."""
    return F.when(F.size(v) >= dims, F.slice(v, 1, dims)).otherwise(F.raise_error(F.lit(f"a vector has fewer than {dims} components")))


def random_projection(v: Column, dims: int, out: int, seed: int = 42) -> Column:
    """Product with a Gaussian matrix, not scaled; the matrix stands in the
    expression, so ``dims * out`` should stay in the thousands."""
    matrix = np.random.default_rng(seed).standard_normal((dims, out))
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in column])) for column in matrix.T])


def pca(corpus: DataFrame, out: int, sample: int = 10_000, whiten: bool = False):
    """A function from ``id, v`` to the same reduced to ``out`` components.

    Fitted on the ``sample`` rows of smallest id (a documented bound), with
    their mean taken off; ``whiten`` divides by each component's deviation.
    """
    rows = corpus.orderBy("id").limit(sample).select(F.col("v").cast("array<double>").alias("v"))
    means = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").collect()
    mean = F.array(*[F.lit(float(r["m"])) for r in means])

    def centred(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.zip_with(F.col("v").cast("array<double>"), mean, lambda x, m: x - m)))

    model = PCA(k=out, inputCol="features", outputCol="reduced").fit(centred(rows))
    made = vector_to_array(F.col("reduced"))
    if whiten:
        spread = centred(rows).transform(model.transform).select(F.posexplode(made).alias("k", "x")).groupBy("k").agg(F.stddev_samp("x").alias("s")).orderBy("k").collect()
        scale = F.array(*[F.lit(max(float(r["s"]), EPSILON)) for r in spread])
        made = F.zip_with(made, scale, lambda x, s: x / s)
    return lambda df: model.transform(centred(df)).withColumn("v", made).select(*df.columns)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, most_queries: int = 10_000) -> DataFrame:
    """``query, id, score, rank``: of each row of ``queries`` (``query, v``)
    the k rows of ``corpus`` (``id, v``) with the greatest dot product, itself
    left out; ties to the smaller id.

    The query set is stated and bounded, so it is sent to the corpus; each
    task keeps k rows a query before the shuffle.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"at most {most_queries} queries at once; search in blocks")
    asked = F.broadcast(queries.select("query", F.col("v").alias("qv")))
    pairs = corpus.join(asked, F.col("query") != F.col("id")).select("query", "id", F.round(dot(F.col("qv"), F.col("v")), 12).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)


def judged(found: DataFrame, qrels: DataFrame) -> DataFrame:
    """``found`` with ``relevant`` by ``qrels`` (``query, id``)."""
    return found.join(qrels.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left").withColumn("relevant", F.col("hit").isNotNull()).drop("hit")


def quality(found: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of means over queries with relevant ids: hit rates at 1, 5, 10
    and 20 (any relevant id), MRR at 10 and nDCG at 10; zeros without any."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    wanted = qrels.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = judged(found, qrels).where("relevant").groupBy("query").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    each = wanted.join(rows, "query", "left")
    means = [F.avg((F.coalesce("first", F.lit(10**9)) <= cut).cast("double")).alias(f"hit_rate_{cut}") for cut in CUTS]
    means += [F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)).alias("mrr_10"), F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_10")]
    one = each.agg(*means)
    return one.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in one.columns])


def missing_queries(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Faults of a benchmark: queries without qrels, qrels of unknown ids."""
    none = queries.join(qrels, "query", "left_anti").select(F.col("query").cast("string").alias("key"), F.lit("no_qrels").alias("fault"))
    unknown = qrels.join(corpus, "id", "left_anti").select(F.col("id").cast("string").alias("key"), F.lit("unknown_id").alias("fault")).distinct()
    return none.unionByName(unknown)


def restrict(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Qrels whose id is in the corpus; queries left with none disappear."""
    return qrels.join(corpus.select("id"), "id", "left_semi")


def storage_bytes(n: Column, dims: Column) -> Column:
    return n * dims * 4
