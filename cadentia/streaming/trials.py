"""Trials over a stream: taps gather in a trial's state, and are cleaned once the watermark has passed the trial's end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import matching
from ..operators.timing import SECOND, clean_array


def cleaned_trials(taps: DataFrame, time: str = "ts", late: str = "10 seconds", quiet_ms: int = 30_000, stop_us: int = 30 * SECOND) -> DataFrame:
    """(stem_id, participant, tap_us) as the batch form ``timing.cleaned_fast`` has them, a trial at a time.

    taps: stem_id, participant, tap_us (place in the trial) and an event
    time.  The filter looks at a whole trial, so a trial is held, as its
    distinct taps, until the watermark is ``quiet_ms`` past its last tap; then
    it is given out and its state goes.  Rows later than the watermark are
    dropped, and with them only what came after a trial was given out.
    """

    def trial(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = clean_array(np.array(sorted(state.get[0]), np.int64))
            state.remove()
            yield pd.DataFrame({"stem_id": [key[0]] * len(held), "participant": [key[1]] * len(held), "tap_us": held})
            return
        held, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        for b in batches:
            inside = b[(b["tap_us"] >= 0) & (b["tap_us"] <= stop_us)]
            held.update(int(x) for x in inside["tap_us"])
            last = max(last, int(b["at_ms"].max()))
        state.update((sorted(held), last))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))

    rows = taps.withWatermark(time, late).select("stem_id", "participant", F.col("tap_us").cast("long").alias("tap_us"), F.unix_millis(time).alias("at_ms"), time)
    schema = "stem_id string, participant long, tap_us long"
    return rows.groupBy("stem_id", "participant").applyInPandasWithState(trial, schema, "taps array<long>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def scored_trials(taps: DataFrame, beats: DataFrame, path: str, checkpoint: str, tolerance_us: int = 70_000, **options) -> StreamingQuery:
    """Append each finished trial's cleaned taps with their nearest beat to Parquet files at ``path``; beats: stem_id and beat_us.

    A batch is written under its number, so one that is tried again after a loss is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        events = batch.select("stem_id", "participant", F.col("tap_us").alias("t_us"))
        near = matching.nearest(events, beats, ["stem_id"]).withColumn("hit", F.coalesce(F.abs("off_us") <= tolerance_us, F.lit(False)))
        near.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cleaned_trials(taps, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
