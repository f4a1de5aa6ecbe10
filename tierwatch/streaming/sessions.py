"""What a session has to do again: uploads, scenarios and news fetches folded
into keyed state, one session a key.

An upload whose contents differ from the session's current ones asks for
validation, scoring and text, and forgets the last fetch; contents come and
go, so A, B, A asks three times.  A new scenario asks for scoring and text once there is an upload, not
for validation.  A request for news asks for a fetch if there was none or the
last one is more than the time to live ago.

State is three values a session, kept by Spark's state store between batches;
``session_work`` is the stream, and a replayed batch starts from the state
before it.  Within a batch a session's events are taken in the order of ``at``
and ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C

EVENT_SCHEMA = "session string, seq bigint, at timestamp, kind string, value string"
STATE_SCHEMA = "upload string, scenario string, fetched bigint"
OUT_SCHEMA = "session string, seq bigint, stage string"
AFTER_UPLOAD = ("validate", "score", "text")
AFTER_SCENARIO = ("score", "text")


def steps(state: tuple, kind: str, value: str | None, at_us: int,
          ttl_seconds: int = C.NEWS_TTL_SECONDS) -> tuple[tuple, tuple]:
    """(new state, stages to do) after one event; ``state`` is (upload,
    scenario, microseconds of the last fetch)."""
    upload, scenario, fetched = state
    if kind == "upload" and value is not None and value != upload:
        return (value, scenario, None), AFTER_UPLOAD
    if kind == "scenario" and value != scenario:
        return (upload, value, fetched), AFTER_SCENARIO if upload is not None else ()
    if kind == "news" and (fetched is None or at_us - fetched > ttl_seconds * 1_000_000):
        return (upload, scenario, at_us), ("news",)
    return state, ()


_NO_TIME = (1 << 63) - 1        # events without a time come last


def _fold(ttl_seconds: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(parts)                                    # one session, one batch
        at, seq, kind, value = (np.concatenate([p[c].to_numpy() for p in held]) for c in ("at", "seq", "kind", "value"))
        order = np.lexsort((seq, at))                         # stable, missing values last
        now = state.get if state.exists else (None, None, None)
        out = []
        micros = np.where(at == _NO_TIME, np.iinfo(np.int64).min, at)
        for seq, at, kind, value in zip(*(x[order].tolist() for x in (seq, micros, kind, value))):
            now, stages = steps(tuple(now), kind, None if pd.isna(value) else value, int(at), ttl_seconds)
            out += [(key[0], int(seq), s) for s in stages]
        state.update(now)
        if out:                                               # frames cost more than the fold of a session
            yield pd.DataFrame(out, columns=["session", "seq", "stage"])
    return run


def session_work(events: DataFrame, ttl_seconds: int = C.NEWS_TTL_SECONDS) -> DataFrame:
    """(session, seq, stage): the stages that each event of a stream of
    ``EVENT_SCHEMA`` rows asks for."""
    # times as numbers: a column of timestamps costs every session a conversion
    micros = events.select("session", "seq", F.coalesce(F.unix_micros("at"), F.lit(_NO_TIME)).alias("at"), "kind", "value")
    return micros.groupBy("session").applyInPandasWithState(
        _fold(ttl_seconds), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_sessions(spark, source_dir: str, sink: str, checkpoint: str, ttl_seconds: int = C.NEWS_TTL_SECONDS,
                    max_files_per_trigger: int | None = None, available_now: bool = True):
    """Events landing as parquet files -> stages to do, appended to ``sink``."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (session_work(reader.parquet(source_dir), ttl_seconds).writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
