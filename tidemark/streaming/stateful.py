"""Streams with state of their own by key, and streams that set aside what they cannot use.

Extensions, like the other streams. Within a batch a key's rows are taken in order of time; a row older than what the key's
state has reached is marked late and changes nothing, so results do not depend on how rows are dealt to batches as long as
batches follow one another in time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder

KEPT = 64  # differences that a key's state holds


def label(step: float, before: list[float]) -> str:
    """a change in words: a decline is unusual where it lies two scaled median deviations below the last differences, of
    which five are needed."""
    z = None
    if len(before) >= 5:
        middle = float(np.median(before))
        spread = 1.4826 * float(np.median(np.abs(np.array(before) - middle)))
        z = (step - middle) / spread if spread > 1e-9 else None
    if step <= -0.05:
        return "UNUSUAL DECLINE" if z is not None and z <= -2 else "DECLINE"
    return "GREENING" if step >= 0.05 else "STABLE"


def change_labels(scenes: DataFrame) -> DataFrame:
    """A stream ``(aoi long, scene long, ts timestamp, value double)`` -> ``(aoi, scene, step, label)``: every scene against
    the one before of its area, judged by the area's last 64 differences; the first scene has no step and 'NO DATA'."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached, number, value, steps = state.get if state.exists else (None, None, None, [])
        steps = list(steps)
        rows = pd.concat(list(batches)).sort_values(["ts", "scene"])
        out = []
        for scene, ts, new in zip(rows["scene"].tolist(), rows["ts"].tolist(), rows["value"].tolist()):
            if reached is not None and (ts.value // 1000, scene) <= (reached, number):
                out.append((key[0], scene, None, "LATE"))
                continue
            step = None if value is None else new - value
            out.append((key[0], scene, step, "NO DATA" if step is None else label(step, steps)))
            if step is not None:
                steps = [*steps, step][-KEPT:]
            reached, number, value = ts.value // 1000, scene, new
        state.update((reached, number, value, steps))
        yield pd.DataFrame(out, columns=["aoi", "scene", "step", "label"])

    return scenes.select("aoi", "scene", "ts", "value").groupBy("aoi").applyInPandasWithState(
        work, "aoi long, scene long, step double, label string", "reached long, number long, value double, steps array<double>", "append", GroupStateTimeout.NoTimeout
    )


def cached(requests: DataFrame, hours: float = 6.0, late: str = "1 day") -> DataFrame:
    """A stream ``(key long, id long, ts timestamp, complete boolean)`` -> ``(key, id, answer)``: 'cached' where a complete
    result of the key is under ``hours`` old, else 'computed'; incomplete results are not kept. A key's state goes once the
    watermark has passed the end of what it holds."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (held,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for id_, ts, complete in zip(rows["id"].tolist(), rows["ts"].tolist(), rows["complete"].tolist()):
            now = ts.value // 1000
            fresh = held is not None and 0 <= now - held < hours * 3600e6
            out.append((key[0], id_, "cached" if fresh else "computed"))
            if complete and not fresh and (held is None or now >= held):
                held = now
        if held is None:
            state.remove()
        else:
            state.update((held,))
            ends = int((held + hours * 3600e6) // 1000)
            if ends > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(ends)
        yield pd.DataFrame(out, columns=["key", "id", "answer"])

    timed = requests.select("key", "id", "ts", "complete").withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(work, "key long, id long, answer string", "held long", "append", GroupStateTimeout.EventTimeTimeout)


def set_aside(stream: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Run a stream over all there is; rows with a null ``reason`` go to one table, the others with it to another, from
    which a next run can take them up. Returns both. Each batch has folders of its own, so a batch that is run again after a
    failure overwrites what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    tagged = stream.withColumn("reason", reason)
    seen: set[int] = set()

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/all/batch={number}")  # read once, however the rows are then split
        rows = spark.read.schema(tagged.schema).parquet(f"{base}/all/batch={number}")
        rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{base}/good/batch={number}")
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{base}/aside/batch={number}")
        seen.add(number)

    run = tagged.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema), spark.createDataFrame([], tagged.schema)
    paths = lambda kind: [f"{base}/{kind}/batch={n}" for n in sorted(seen)]
    return spark.read.schema(stream.schema).parquet(*paths("good")), spark.read.schema(tagged.schema).parquet(*paths("aside"))
