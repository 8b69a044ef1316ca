"""Chat sessions from a stream of turns: each conversation's turns in their order, whatever order they arrive in.

The state of a conversation is the number of the turn it waits for and the turns that came too early.
A turn goes out when all before it have; greetings are answered on the way out, from the fixed table. A
turn that was sent already is left out, so files that are offered twice change nothing; of two different
texts of one turn the first to go out stays (in one batch the smaller). What still waits stays in the
state; with a ``patience``, for streams that go on, it goes out in order when the conversation has been
silent so long, gaps and all, marked ``late``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.chat import route_greetings

TURNS = "conv_id bigint, turn bigint, role string, text string"
SESSION = "conv_id bigint, turn bigint, role string, text string, late boolean"
STATE = "next bigint, waiting string"


def ordered(turns: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """``conv_id, turn, role, text, late`` of a stream of turns, numbered from 0 in each conversation, in their order."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held = state.get if state.exists else (0, "[]")
        waiting = {t: (r, x) for t, r, x in json.loads(held)}
        out = []
        if state.hasTimedOut:
            out = [(key[0], t, r, x, True) for t, (r, x) in sorted(waiting.items())]
            at, waiting = max([at, *[t + 1 for t in waiting]]), {}
        else:
            for pdf in batches:
                for t, r, x in pdf[["turn", "role", "text"]].itertuples(index=False):
                    own = (None if pd.isna(r) else r, None if pd.isna(x) else x)
                    if not pd.isna(t) and t >= at:
                        known = waiting.get(int(t))
                        waiting[int(t)] = own if known is None else min(known, own, key=lambda v: tuple(y or "" for y in v))
            while at in waiting:
                out.append((key[0], at, *waiting.pop(at), False))
                at += 1
        state.update((at, json.dumps(sorted((t, r, x) for t, (r, x) in waiting.items()))))
        if waiting and patience_ms is not None:
            state.setTimeoutDuration(patience_ms)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "late"])

    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").applyInPandasWithState(step, SESSION, STATE, "append", timeout)


def stream_sessions(spark: SparkSession, source_dir: str, glob: str, out_path: str, checkpoint: str, schema: str | T.StructType = TURNS,
                    max_files: int = 100, patience_ms: int | None = None) -> None:
    """Log the sessions of the turns in ``source_dir``, without ``patience_ms`` until no file is left (``availableNow``), else for good: ``conv_id, turn, role, text, late,
    is_greeting, reply``, one folder a batch, which a replay of the batch overwrites. Order within a conversation is that of ``turn``."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # a reply is for what a user says
        routed = route_greetings(batch.sparkSession, batch, "text").drop("normalized")
        said = F.col("is_greeting") & (F.col("role") == "user")
        routed.withColumns({"reply": F.when(said, F.col("reply")), "is_greeting": F.coalesce(said, F.lit(False))}).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    turns = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    w = ordered(turns.select("conv_id", "turn", "role", "text"), patience_ms).writeStream.outputMode("append").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    # a timeout by the clock asks for one batch after the other, so such a stream has no end of its own
    (w.trigger(availableNow=True) if patience_ms is None else w).start().awaitTermination()
