"""Windowed and stateful forms for streams; each also takes a batch table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming and late else df


def fixed_bins(df: DataFrame, time: str, by: str, value: str, width: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Mean and count per entity in fixed (or sliding) windows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = _late(df, time, late).groupBy(window.alias("w"), by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


def sessions(df: DataFrame, time: str, by: str, gap: str, late: str | None = "1 hour") -> DataFrame:
    """Runs of events with no gap as long as ``gap``."""
    out = _late(df, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def onset_stream(df: DataFrame, by: str, index: str, flag: Column, run: int) -> DataFrame:
    """The first index of each entity that starts ``run`` true rows in a row, as soon as it is seen.

    The state of an entity is the start and length of its current run, or that it has been reported.
    Rows of a micro-batch are taken in order of their index.
    """
    rows = df.select(F.col(by).cast("string").alias("entity"), F.col(index).cast("long").alias("i"), flag.alias("flag"))

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, length, done = state.get if state.exists else (0, 0, False)
        found = None
        for pdf in batches:
            for i, ok in pdf.sort_values("i")[["i", "flag"]].itertuples(index=False):
                if done:
                    break
                if not ok:
                    length = 0
                elif length and i == start + length:
                    length += 1
                else:
                    start, length = int(i), 1
                if length >= run:
                    done, found = True, start
        state.update((start, length, done))
        if found is not None:
            yield pd.DataFrame({"entity": [key[0]], "onset": [found]})

    return rows.groupBy("entity").applyInPandasWithState(step, "entity string, onset long", "start long, length long, done boolean", "append", GroupStateTimeout.NoTimeout)
