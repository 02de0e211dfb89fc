"""A domain of pixel rows divided among seeds: by flooding over levels, by distance, by two scores."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget
from . import polyline

#: Steps and owner of a cell that no seed has reached.
NONE = np.iinfo(np.int64).max


def _sources(grid: dict[str, np.ndarray], known: np.ndarray) -> tuple[list[int], list[bool]]:
    """Places of known cells in the flat grid, and which places may be reached: a row more, for steps beyond its end."""
    return np.flatnonzero(known).tolist(), [*grid["open"].ravel().tolist(), *[False] * grid["open"].shape[1]]


def _heights(grid: dict[str, np.ndarray]) -> None:
    """Lowest passes: the least, over ways from a seed, of the highest level on the way."""
    grid["open"] = grid["inside"]
    height, level, width = grid["height"].ravel().tolist(), grid["level"].ravel().tolist(), grid["height"].shape[1]
    # what is known inside came from these, so only they can lower it
    begun, open_ = _sources(grid, np.isfinite(grid["height"]) & (~grid["inside"] | grid["fixed"]))
    heap = [(height[i], i) for i in begun]
    heapq.heapify(heap)
    while heap:
        h, i = heapq.heappop(heap)
        if h > height[i]:
            continue
        for q in (i - width, i - 1, i + 1, i + width):
            if open_[q]:
                new = h if h > level[q] else level[q]
                if new < height[q]:
                    height[q] = new
                    heapq.heappush(heap, (new, q))
    grid["height"] = np.array(height).reshape(-1, width)


def _owners(grid: dict[str, np.ndarray]) -> None:
    """Steps and owners: from lower passes in one step, else from cells of the same pass, the smaller owner on ties."""
    grid["open"] = grid["inside"] & ~grid["fixed"] & np.isfinite(grid["height"])
    for name in ("steps", "owner"):  # found anew: an owner that was told may have given way to a larger one
        grid[name][grid["open"]] = NONE
    height, steps, owner, width = *(grid[n].ravel().tolist() for n in ("height", "steps", "owner")), grid["height"].shape[1]
    begun, open_ = _sources(grid, grid["steps"] < NONE)
    heap = [(height[i], steps[i], owner[i], i) for i in begun]
    heapq.heapify(heap)
    while heap:
        h, n, whose, i = heapq.heappop(heap)
        if n != steps[i] or whose != owner[i]:
            continue
        for q in (i - width, i - 1, i + 1, i + width):
            if open_[q] and height[q] >= h:
                new = n + 1 if height[q] == h else 1
                if new < steps[q] or new == steps[q] and whose < owner[q]:
                    steps[q], owner[q] = new, whose
                    heapq.heappush(heap, (height[q], new, whose, q))
    for name, found in (("steps", steps), ("owner", owner)):
        grid[name] = np.array(found, np.int64).reshape(-1, width)


def _until_settled(state: DataFrame, by: Sequence[str], tile: int, settle: Callable[[dict[str, np.ndarray]], None]) -> DataFrame:
    """Settle all tiles side by side, tell cells on their edges to the next tiles, until no cell changes."""
    own = [*by, "_x", "_y", "_level", "_fixed", "_height", "_steps", "_owner"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["_tx"].iloc[0]), int(pdf["_ty"].iloc[0])
        i, j = (pdf["_x"] - tx * tile + 1).to_numpy(), (pdf["_y"] - ty * tile + 1).to_numpy()
        grid = {}
        for name, none in (("level", np.inf), ("height", np.inf), ("steps", NONE), ("owner", NONE), ("fixed", False)):
            grid[name] = np.full((tile + 2, tile + 2), none)
            grid[name][i, j] = pdf[f"_{name}"].to_numpy()
        grid["inside"] = np.zeros((tile + 2, tile + 2), dtype=bool)
        here = ~pdf["_told"].to_numpy(dtype=bool)
        i, j, pdf = i[here], j[here], pdf[here].drop(columns=["_told", "_tx", "_ty"])
        grid["inside"][i, j] = True
        settle(grid)
        new = pdf.assign(**{f"_{n}": grid[n][i, j] for n in ("height", "steps", "owner")})
        changed = (new["_height"] != pdf["_height"]) | (new["_steps"] != pdf["_steps"]) | (new["_owner"] != pdf["_owner"])
        return new.assign(_changed=changed)[[*own, "_changed"]]

    tx, ty = (F.floor(F.col(c) / tile).cast("long") for c in ("_x", "_y"))
    edges = [F.when(F.pmod(c, F.lit(tile)) == at, F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))) for c, at, dx, dy in ((F.col("_x"), 0, -1, 0), (F.col("_x"), tile - 1, 1, 0), (F.col("_y"), 0, 0, -1), (F.col("_y"), tile - 1, 0, 1))]
    schema = state.select(*own).withColumn("_changed", F.lit(True)).schema
    while True:
        rows = state.select(*own, tx.alias("_tx"), ty.alias("_ty"), F.lit(False).alias("_told"))
        over = state.where(F.col("_height") < float("inf")).withColumn("_e", F.explode(F.array_compact(F.array(*edges))))
        over = over.select(*own, (tx + F.col("_e.dx")).alias("_tx"), (ty + F.col("_e.dy")).alias("_ty"), F.lit(True).alias("_told"))
        new = cut(rows.unionByName(over).groupBy(*by, "_tx", "_ty").applyInPandas(solve, schema))
        forget(state)
        state = new
        if state.where("_changed").isEmpty():
            return state


def flood(cells: DataFrame, by: Sequence[str], x: str, y: str, seed: str, level: str | None = None, tile: int = 256) -> DataFrame:
    """(by, x, y, owner, height, steps): each cell's seed, as a watershed over ``level``, or by steps where it is None.

    Cells (whole numbers, four neighbours) are reached level by level: a cell's ``height`` is its lowest pass, the
    least that the highest level on a way from a seed can be. Within a height fronts go from cells of lower height,
    and from seeds, a step at a time; the smaller label wins where fronts meet. ``seed`` is null in other cells;
    labels are longs. Cells that no seed reaches have nulls, and so do cells without a level, which are not crossed.
    A place given several times is one cell of its least level and seed; cells without a place are left out.

    Tiles are settled by themselves and tell their edges to the next ones, so rounds grow with the tiles that a front
    crosses, not with its cells, and no task holds more than a tile.
    """
    at = [F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y")]
    told = F.lit(0.0) if level is None else F.col(level).cast("double")
    rows = cells.select(*by, *at, F.when(~F.isnan(told), told).alias("_l"), F.col(seed).cast("long").alias("_s")).where("_x is not null and _y is not null")
    rows = rows.groupBy(*by, "_x", "_y").agg(F.min("_l").alias("_l"), F.min("_s").alias("_s"))
    fixed = F.col("_s").isNotNull() & F.col("_l").isNotNull()
    level_ = F.coalesce("_l", F.lit(float("inf")))
    start = [level_.alias("_level"), fixed.alias("_fixed"), F.when(fixed, F.col("_l")).otherwise(F.lit(float("inf"))).alias("_height"), F.lit(NONE).alias("_steps"), F.lit(NONE).alias("_owner"), "_s"]
    state = _until_settled(cut(rows.select(*by, "_x", "_y", *start).withColumn("_owner", F.when(F.col("_fixed"), F.col("_s")).otherwise(F.col("_owner")))), by, tile, _heights)
    begun = state.withColumn("_steps", F.when(F.col("_fixed"), F.lit(0)).otherwise(F.col("_steps")))
    state = _until_settled(begun, by, tile, _owners)
    reached = F.col("_steps") < F.lit(NONE)
    return state.select(*by, F.col("_x").alias(x), F.col("_y").alias(y), *(F.when(reached, F.col(f"_{n}")).alias(n) for n in ("owner", "height", "steps")))


def by_distance(cells: DataFrame, by: Sequence[str], x: str, y: str, seed: str) -> DataFrame:
    """Each cell with its nearest seed (straight distance, the smaller label on ties) and the ``distance`` to it."""
    cells = cut(cells)  # read for its seeds and as points
    found = polyline.nearest_mark(cells, cells.where(F.col(seed).isNotNull()), by, seed, x, y)
    return found.withColumnRenamed("nearest", "owner")


def by_scores(cells: DataFrame, by: Sequence[str], x: str, y: str, seed: str, first: str, second: str, tile: int = 256) -> DataFrame:
    """(by, x, y, owner): a domain divided between seeds 1 and 2 by which score is higher, and by connection.

    Cells whose ``second`` score is above their ``first`` go to 2 if they are connected with its seeds; of the
    others those connected with seeds of 1 go to 1; what is left goes to 2. Scores that are null or not finite
    never speak for 2. A group with seeds of one kind goes to it whole; one without seeds has null owners. A place
    seeded with both is a seed of 1.
    """
    wins = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    above = F.coalesce(wins(first) & wins(second) & (F.col(second) > F.col(first)), F.lit(False))
    rows = cells.select(*by, F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), F.col(seed).cast("long").alias("_s"), above.alias("_a"))
    rows = rows.where("_x is not null and _y is not null").groupBy(*by, "_x", "_y").agg(F.min("_s").alias("_s"), F.max("_a").alias("_a"))
    rows = cut(rows)
    kinds = rows.groupBy(*by).agg(F.max(F.col("_s") == 1).alias("_one"), F.max(F.col("_s") == 2).alias("_two"))
    for_two = rows.withColumn("_s", F.when(F.col("_s") == 2, 2)).withColumn("_l", F.when(F.col("_a") | (F.col("_s") == 2), 0.0))
    two = flood(for_two, by, "_x", "_y", "_s", "_l", tile).where("owner is not null").select(*by, "_x", "_y", F.lit(True).alias("_in_two"))
    rest = _matched(rows, two, [*by, "_x", "_y"], "_in_two")
    for_one = rest.withColumn("_s", F.when(F.col("_s") == 1, 1)).withColumn("_l", F.when(F.col("_in_two").isNull() | (F.col("_s") == 1), 0.0))
    one = flood(for_one, by, "_x", "_y", "_s", "_l", tile).where("owner is not null").select(*by, "_x", "_y", F.lit(True).alias("_in_one"))
    told = _matched(_matched(rows, one, [*by, "_x", "_y"], "_in_one"), kinds, by, "_one", "_two")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    owner = F.when(has("_one") & has("_two"), F.when(has("_in_one"), 1).otherwise(2)).when(has("_one"), 1).when(has("_two"), 2)
    return told.select(*by, F.col("_x").alias(x), F.col("_y").alias(y), owner.cast("long").alias("owner"))


def _matched(rows: DataFrame, other: DataFrame, on: Sequence[str], *names: str) -> DataFrame:
    """A left join in which null keys meet."""
    side = other.select(*(F.col(c).alias(f"_of_{c}") for c in on), *names)
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(side, test, "left").select(*rows.columns, *names)
