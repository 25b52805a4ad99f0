"""A gated recurrent memory per account that scores its transfers.

The weights are declared by a seed, since none are published; the same step runs
over a stream with keyed state and over a batch in event order.  An account that was
idle for over 30 days starts anew in both; the stream's state is dropped by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .account_state import RETENTION_S, offered_events, run_to_parquet

DIM, INPUT, SEED = 16, 4, 7
#: Fixed value: seconds that an idle account's memory lasts.
MEMORY_S = 30 * 86_400
OUTPUT = "event_id bigint, user_id bigint, score double"
STATE = "memory array<double>, last double"
#: Rows per Arrow batch of an account are unbounded in number, not in state: 17 doubles.
_rng = np.random.default_rng(SEED)
WEIGHTS = {
    name: _rng.normal(0, 0.3, shape)
    for name, shape in (("z", (DIM, INPUT + DIM)), ("r", (DIM, INPUT + DIM)), ("h", (DIM, INPUT + DIM)), ("out", (DIM,)))
}
KINDS = ("view", "click", "purchase", "signup", "error")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80, 80)))


def step(memory: np.ndarray, value: float, kind: str, hour: int, gap: float) -> tuple[np.ndarray, float]:
    """Score with the memory as updated by a message; a non-finite value counts as 0."""
    value = value if np.isfinite(value) else 0.0
    code = KINDS.index(kind) if kind in KINDS else 2
    x = np.array([np.log1p(abs(value)) / 10, code / 4, hour / 24, np.log1p(max(gap, 0.0)) / 20])
    both = np.concatenate([x, memory])
    z, r = _sigmoid(WEIGHTS["z"] @ both), _sigmoid(WEIGHTS["r"] @ both)
    new = np.tanh(WEIGHTS["h"] @ np.concatenate([x, r * memory]))
    memory = (1 - z) * memory + z * new
    return memory, float(_sigmoid(WEIGHTS["out"] @ memory))


def _replay(rows: pd.DataFrame, memory: np.ndarray, last: float) -> tuple[list[tuple], np.ndarray, float]:
    out = []
    for r in rows.sort_values(["ts", "event_id"]).itertuples(index=False):
        at = r.ts.timestamp()
        if last >= 0 and at - last > MEMORY_S:
            memory, last = np.zeros(DIM), -1.0
        memory, score = step(memory, r.value, r.event_type, r.ts.hour, at - last if last >= 0 else 0.0)
        last = at
        out.append((r.event_id, r.user_id, score))
    return out, memory, last


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    memory, last = state.get if state.exists else ([0.0] * DIM, -1.0)
    out, memory, last = _replay(pd.concat(list(frames)), np.array(memory), last)
    state.update((memory.tolist(), last))
    state.setTimeoutTimestamp(int((last + MEMORY_S) * 1000))
    yield pd.DataFrame(out, columns=["event_id", "user_id", "score"])


def score_stream(stream: DataFrame) -> DataFrame:
    timed = stream.withWatermark("ts", f"{RETENTION_S} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def score_batch(events: DataFrame) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_replay(frame, np.zeros(DIM), -1.0)[0], columns=["event_id", "user_id", "score"])

    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return rows.groupBy("user_id").applyInPandas(run, OUTPUT)


def stream_node_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, stream, offers = offered_events(spark, sf_dir, "node-memory", slices=3)
    return run_to_parquet(score_stream(stream), work, "out", offers=offers)


QUERIES = {"stream_node_memory": stream_node_memory}
COVERS = {"stream_node_memory": "T9 T13 E16"}
SQL: dict[str, str] = {}
