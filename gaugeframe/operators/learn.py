"""Projection, communities and ensemble feature selection on Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import joins, stats


def project(reference: DataFrame, other: DataFrame, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``vector`` replaced by k principal components of the reference's z-scores."""
    as_vector = lambda df: df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    ref = as_vector(reference.where(F.col(vector).isNotNull()))
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(ref)
    pca = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaler.transform(ref))
    done = lambda df: pca.transform(scaler.transform(as_vector(df.where(F.col(vector).isNotNull())))).withColumn(vector, vector_to_array("_p")).drop("_v", "_z", "_p")
    return done(reference), done(other)


def transfer_labels(queries: DataFrame, reference: DataFrame, id_col: str, vector: str, label: str, components: int, k: int) -> DataFrame:
    """Labels for query rows by a vote of their nearest reference rows after projection."""
    ref, own = project(reference, queries, vector, components)
    return joins.vote(joins.knn(own, ref, id_col, vector, k), ref, id_col, label)


def marker_weights(df: DataFrame, vector: str, label: str, ridge: float = 0.01) -> DataFrame:
    """Coefficients of a multinomial logistic regression: one row per class and feature."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # labels are few
    number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)) - 1
    rows = df.select(number.cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = LogisticRegression(family="multinomial", regParam=ridge, maxIter=50).fit(rows)
    table = model.coefficientMatrix.toArray()
    return df.sparkSession.createDataFrame([(c, i, float(w)) for c, ws in zip(classes, table) for i, w in enumerate(ws)], f"{label} {dict(df.dtypes)[label]}, feature long, weight double")


def communities(edges: DataFrame, rounds: int, seed: int = 7) -> DataFrame:
    """Label propagation over a weighted edge list (a, b, weight): node and community.

    In each round every node takes the label that weighs most among its neighbours, ties by a seeded
    hash; a fixed number of rounds. Labels are written to the shared checkpoint folder each round.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for n in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        labels = near.groupBy(F.col("a").alias("node")).agg(F.max_by("label", F.struct("w", F.xxhash64("label", F.lit(seed + n)))).alias("label"))
        labels = cut(labels)
    return labels


def chosen_features(x: DataFrame, labels: DataFrame, row: str, feature: str, value: str, label: str, trials: int, share: float, seed: int = 7) -> DataFrame:
    """How often each feature splits two labels best, over seeded trials on sampled rows, against shuffled labels.

    A trial draws rows by hash and one pair of labels, and chooses the feature whose means differ most
    for its spread. ``z``: the count against the counts from shuffled labels. Everything is one plan:
    trials are exploded rows, choices are windows.
    """
    named = labels.where(F.col(label).isNotNull()).select(row, F.col(label).alias("_l"))
    order = F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64("_l", "trial", F.lit(seed))))
    pairs = named.select("_l").distinct().withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("_k", order).where("_k <= 2")
    drawn = named.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).where(F.pmod(F.xxhash64(row, "trial", F.lit(seed)), F.lit(1000)) < int(1000 * share))
    drawn = drawn.join(pairs, ["trial", "_l"]).withColumn("_r", F.xxhash64(row, "trial", F.lit(seed + 1)))
    # labels are shuffled by the order of hashes; a trial is ordered range by range, as many tasks as ranges
    dealt = stats.of_ranges(drawn.withColumn("_range", F.shiftright("_r", 58)), ["trial"])
    sizes = drawn.groupBy("trial").agg(F.count_if(F.col("_k") == 1).alias("_n_a"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("trial", "_range").orderBy("_r", row))
    sides = dealt.join(sizes, "trial").withColumn("real", F.col("_k") == 1).withColumn("shuffled", place <= F.col("_n_a"))
    totals = sides.groupBy("trial").agg(F.count_if("real").alias("n_a"), F.count_if(~F.col("real")).alias("n_b"))
    both = x.join(sides.select(row, "trial", F.explode(F.array(F.struct(F.lit("real").alias("kind"), F.col("real").alias("a")), F.struct(F.lit("shuffled").alias("kind"), F.col("shuffled").alias("a")))).alias("s")), row)
    v = F.col(value)
    sums = both.groupBy("trial", "s.kind", feature).agg(F.sum(F.when(F.col("s.a"), v).otherwise(0.0)).alias("sa"), F.sum(F.when(F.col("s.a"), 0.0).otherwise(v)).alias("sb"), F.sum(v * v).alias("ss"))
    ma, mb = F.try_divide("sa", "n_a"), F.try_divide("sb", "n_b")
    spread = F.sqrt(F.greatest(F.col("ss") / (F.col("n_a") + F.col("n_b")), F.lit(1e-12)))
    scored = sums.join(totals, "trial").withColumn("score", F.round(F.abs(ma - mb) / spread, 9))
    best = scored.groupBy("trial", "kind").agg(F.max_by(feature, F.struct("score", F.col(feature))).alias(feature))
    counts = best.groupBy(feature).agg(F.count_if(F.col("kind") == "real").alias("n"), F.count_if(F.col("kind") == "shuffled").alias("n_shuffled"))
    null = counts.agg(F.avg("n_shuffled").alias("_m"), F.stddev_pop("n_shuffled").alias("_s"))
    return counts.crossJoin(F.broadcast(null)).select(feature, "n", "n_shuffled", F.try_divide(F.col("n") - F.col("_m"), F.col("_s")).alias("z"))  # one row on the right


def batch_neighbours(df: DataFrame, id_col: str, batch: str, vector: str, batches: Sequence, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Each row's k nearest rows within every batch, so that no batch crowds out another.

    ``queries``: the rows to find neighbours of, where not all of ``df``.
    """
    queries = df if queries is None else queries
    found = None
    for b in batches:
        one = joins.knn(queries, df.where(F.col(batch) == b), id_col, vector, k).withColumn("batch", F.lit(b))
        found = one if found is None else found.unionByName(one)
    return found
