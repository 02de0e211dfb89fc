"""Panels of features judged by how labels of one table match those of another: incremental scores, beam search.

A panel's correlations come from sums over its features. A move (a feature dropped, added or swapped) changes these
sums by the terms of the features that leave and enter, so no panel is ever summed up again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget

SUMS = ("x", "y", "xx", "yy", "xy")

#: Digits that correlations are compared by.
DIGITS = 9

#: How relations rank; a pair of labels related in several ways counts by the first.
KINDS = ("preferred", "soft", "family")


def terms(one: DataFrame, other: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """(feature, a, b, x, y, xx, yy, xy): what a feature adds to the sums of each pair of labels.

    Absent values are 0. Labels of either table are listed on the driver: they are the groups compared, not rows.
    """
    def full(df: DataFrame, name: str, v: str) -> DataFrame:
        labels = sorted(r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().collect())
        if not labels:
            return df.select(F.col(feature).cast("string").alias("feature"), F.lit("").alias(name), F.lit(0.0).alias(v)).limit(0)
        known = df.where(F.col(label).isNotNull()).groupBy(F.col(feature).cast("string").alias("feature"), F.col(label).cast("string").alias("_l")).agg(F.sum(F.col(value).cast("double")).alias("_v"))
        told = known.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("_l", "_v"))).alias("_of"))
        rows = told.select("feature", F.explode(F.array(*(F.lit(k) for k in labels))).alias(name), "_of")
        return rows.select("feature", name, F.coalesce(F.try_element_at("_of", F.col(name)), F.lit(0.0)).alias(v))

    met = full(one, "a", "x").join(full(other, "b", "y"), "feature")
    return met.withColumns({"xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")})


def _key(feature: Column) -> Column:
    """Keys of panels are these of their features, xored, so a move changes a key by the features it moves."""
    return F.xxhash64(feature)


def summed(told: DataFrame, panels: DataFrame) -> DataFrame:
    """(panel, a, b, n, sums) of panels given as rows (panel, feature), by full summation."""
    rows = panels.select("panel", F.col("feature").cast("string").alias("feature")).distinct()
    return rows.join(told, "feature").groupBy("panel", "a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in SUMS))


def moved(told: DataFrame, sums: DataFrame, moves: DataFrame) -> DataFrame:
    """Sums after moves (panel, parent, dropped, added), from the parents' sums and the terms of what moves."""
    rows = moves.join(sums.withColumnRenamed("panel", "parent"), "parent")
    for name, sign in (("dropped", -1), ("added", 1)):
        side = told.select(F.col("feature").alias(name), "a", "b", F.lit(sign).alias("_n"), *(F.col(c).alias(f"_{c}") for c in SUMS))
        rows = rows.join(side, [name, "a", "b"], "left")
        rows = rows.withColumns({c: F.col(c) + sign * F.coalesce(f"_{c}", F.lit(0.0)) for c in SUMS} | {"n": F.col("n") + F.coalesce("_n", F.lit(0))}).drop("_n", *(f"_{c}" for c in SUMS))
    return rows.select("panel", "a", "b", "n", *SUMS)


def matches(sums: DataFrame, relations: DataFrame) -> DataFrame:
    """(panel, n, a, ...): each label's best match in each panel, its category, gap and margins.

    ``relations`` has rows (a, b, kind) with the kinds ``preferred``, ``soft`` and ``family``. The category is that
    of the best match, ``bad`` for an unrelated one, and ``unscored`` for a label that prefers none. ``gap``: best
    less second correlation; ``margin_all`` and ``margin_bad``: best preferred correlation less the best of all
    others, or of unrelated ones. Undefined correlations (no spread within the panel) come last and lend no margin;
    the smaller label wins ties. Correlations are taken to 9 digits, so that ties don't hang on rounding errors.
    """
    rank = F.min(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")).alias("_kind")
    kinds = relations.where(F.col("kind").isin(*KINDS)).groupBy(F.col("a").cast("string").alias("_a"), F.col("b").cast("string").alias("_b")).agg(rank)
    n = F.col("n").cast("double")
    left, right = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    # sums leave rounding errors where there is no spread
    spread = (left > 1e-12 * n * F.col("xx")) & (right > 1e-12 * n * F.col("yy"))
    r = F.round(F.when(spread, (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(left) / F.sqrt(right)), DIGITS)
    rows = sums.select("panel", "n", "a", "b", r.alias("r")).join(kinds, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").drop("_a", "_b")
    order = F.struct(F.col("r").isNull().alias("none"), (-F.col("r")).alias("less"), F.col("b").alias("b"), F.coalesce("_kind", F.lit(4)).alias("kind"))
    best = lambda test: F.max(F.when(test, F.col("r")))
    preferred = F.coalesce(F.col("_kind") == 1, F.lit(False))
    told = rows.groupBy("panel", "a").agg(
        F.max("n").alias("n"),
        F.slice(F.sort_array(F.collect_list(order)), 1, 2).alias("_top"),  # as many as there are labels
        F.max(preferred).alias("_prefers"),
        best(preferred).alias("_own"),
        best(~preferred).alias("_others"),
        best(F.col("_kind").isNull()).alias("_bad"),
    )
    corr = lambda i: -F.get("_top", F.lit(i))["less"]
    name = F.element_at(F.array(*(F.lit(k) for k in (*KINDS, "bad"))), F.col("_top")[0]["kind"])
    return told.select(
        "panel", "n", "a", F.col("_top")[0]["b"].alias("best"), corr(0).alias("correlation"), (corr(0) - corr(1)).alias("gap"),
        F.when(F.col("_prefers"), name).otherwise("unscored").alias("category"),
        (F.col("_own") - F.col("_others")).alias("margin_all"), (F.col("_own") - F.col("_bad")).alias("margin_bad"),
    )


def scores(sums: DataFrame, relations: DataFrame) -> DataFrame:
    """One row a panel: size, labels by category, rates, median margins and gap, mean best correlation."""
    count = lambda kind: F.count_if(F.col("category") == kind)
    scored = F.count_if(F.col("category") != "unscored")
    median = lambda c: F.percentile(c, 0.5).alias(c)  # noqa: E731  of as many values as there are labels
    return matches(sums, relations).groupBy("panel").agg(
        F.max("n").alias("size"), *(count(k).alias(k) for k in ("bad", "soft", "family")),
        F.try_divide(count("preferred"), scored).alias("preferred_rate"), F.try_divide(scored - count("bad"), scored).alias("acceptable_rate"),
        median("margin_bad"), median("margin_all"), median("gap"), F.avg("correlation").alias("correlation"),
    )


def order() -> list[Column]:
    """Best panels first: fewest bad, soft and family matches, widest margins and gap, fewest features."""
    wide = [F.desc_nulls_last(c) for c in ("margin_bad", "margin_all", "gap")]
    return [F.asc("bad"), F.asc("soft"), F.asc("family"), *wide, F.asc("size"), F.asc("panel")]


def all_moves(panels: DataFrame, features: Sequence[str], kinds: Sequence[str] = ("drop", "add", "swap"), least: int = 2) -> DataFrame:
    """(panel, parent, dropped, added): moves from panels given as rows (panel, features), each new panel once.

    Moves are made within each panel's row from the features it has and lacks.
    """
    every = F.array(*(F.lit(f) for f in sorted(set(features))))
    rows = panels.select(F.col("panel").alias("parent"), F.col("features").alias("_has"), F.array_except(every, F.col("features")).alias("_lacks"))
    none, parts = F.lit(None).cast("string"), []
    if "drop" in kinds:
        parts.append(rows.where(F.size("_has") > least).select("parent", F.explode("_has").alias("dropped"), none.alias("added")))
    if "add" in kinds:
        parts.append(rows.select("parent", none.alias("dropped"), F.explode("_lacks").alias("added")))
    if "swap" in kinds:
        parts.append(rows.select("parent", "_lacks", F.explode("_has").alias("dropped")).select("parent", "dropped", F.explode("_lacks").alias("added")))
    moves = parts[0]
    for part in parts[1:]:
        moves = moves.unionByName(part)
    change = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(_key(F.col(c)))
    keyed = moves.withColumn("panel", F.col("parent").bitwiseXOR(change("dropped")).bitwiseXOR(change("added")))
    return keyed.groupBy("panel").agg(F.min(F.struct("parent", "dropped", "added")).alias("_m")).select("panel", "_m.*")


def keyed(spark, panels: Sequence[Sequence[str]]) -> DataFrame:
    """(panel, features): panels under their keys."""
    rows = spark.createDataFrame([(sorted(set(p)),) for p in panels], "features array<string>")
    key = F.aggregate(F.transform("features", _key), F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(k))
    return rows.select(key.alias("panel"), "features").dropDuplicates(["panel"])


def search(told: DataFrame, relations: DataFrame, start: Sequence[str], features: Sequence[str], width: int, rounds: int, patience: int = 2, kinds: Sequence[str] = ("drop", "add", "swap")) -> DataFrame:
    """(panel, round, features, scores): the beam of every round, from the starting panel as round 0.

    Each round scores all moves from the beam in one job and keeps the best ``width`` panels that were in no beam
    before; it ends after ``patience`` rounds without a better best. The driver holds beams, never moves.
    """
    spark = told.sparkSession
    known = {r[0] for r in told.select("feature").distinct().where(F.col("feature").isin(*map(str, {*start, *features}))).collect()}
    told = cut(told.where(F.col("feature").isin(*known)))
    beam = keyed(spark, [[f for f in map(str, start) if f in known]])
    sums = cut(summed(told, beam.select("panel", F.explode("features").alias("feature"))))
    kept = scores(sums, relations).join(beam, "panel").withColumn("round", F.lit(0)).collect()
    schema = scores(sums, relations).join(beam, "panel").withColumn("round", F.lit(0)).schema
    history, better, idle = list(kept), kept[:1], 0
    for turn in range(1, rounds + 1):
        if not kept or idle >= patience:
            break
        beam = spark.createDataFrame([(r["panel"], r["features"]) for r in kept], "panel long, features array<string>")
        moves = all_moves(beam, [str(f) for f in features if str(f) in known], kinds)
        moves = cut(moves.where(~F.col("panel").isin(*(r["panel"] for r in history))))
        best = scores(moved(told, sums, moves), relations).orderBy(*order()).limit(width)
        drop = F.filter("_had", lambda f: F.col("dropped").isNull() | (f != F.col("dropped")))
        have = F.sort_array(F.concat(drop, F.array_compact(F.array("added"))))
        chosen = best.join(moves, "panel").join(beam.select(F.col("panel").alias("parent"), F.col("features").alias("_had")), "parent")
        kept = chosen.select(*(c for c in schema.names if c not in ("round", "features")), have.alias("features"), F.lit(turn).alias("round")).select(*schema.names).orderBy(*order()).collect()
        following = cut(moved(told, sums, moves.where(F.col("panel").isin(*(r["panel"] for r in kept)))))
        forget(sums), forget(moves)
        sums = following
        history += kept
        ranked = spark.createDataFrame([*better, *kept[:1]], schema).orderBy(*order()).first() if better and kept else None
        idle, better = (idle + 1, better) if ranked is None or ranked["panel"] == better[0]["panel"] else (0, [ranked])
    return spark.createDataFrame(history, schema)
