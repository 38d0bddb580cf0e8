"""Scores of samples whose calls are still arriving.

The state of a sample is its last call, that call's run and its code; every
trigger turns the calls that arrived into counted steps. A second stream joins
the steps with the model and adds them up by sample, so a score never needs the
calls again, and after the last call it is the batch scorer's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqlab import fixed_values as V
from seqlab.functions import cleaning
from seqlab.operators.markov import TransitionModel

STEP_COLUMNS = "sample_id string, a int, b int, n long"
STATE_COLUMNS = "pos long, token string, run long, code int"
# a row of the step stream that counts calls, not steps
CALLS = -1


def follow_calls(
    calls: DataFrame, encode: Callable[[DataFrame, str], DataFrame], max_repeats: int | None = V.MAX_CONSECUTIVE_DUPLICATES,
    idle_ms: int | None = None,
) -> DataFrame:
    """A stream of (sample_id, pos, token) to one of (sample_id, a, b, n): the counted steps of each trigger.

    Calls are lower-cased, sandbox tokens leave, and runs keep their first ``max_repeats`` calls, over triggers too. A
    row whose a and b are -1 counts the calls that came. Calls of a sample arrive by rising ``pos``, in any order
    inside a trigger; one at or before the last position seen is a repeat and is left out, as are null ids, positions
    and tokens. One task holds a sample's calls of one trigger. A sample without calls for ``idle_ms`` is
    forgotten; later calls start it anew, without the step over the pause.
    """
    listed = calls.where(F.col("sample_id").isNotNull() & F.col("pos").isNotNull() & F.col("token").isNotNull())
    cleaned = listed.select("sample_id", F.col("pos").cast("long").alias("pos"), cleaning.external(F.array("token")).alias("sequence"))
    coded = encode(cleaned, "encoded").select(
        "sample_id", "pos", F.get("sequence", F.lit(0)).alias("token"), F.get("encoded", F.lit(0)).cast("int").alias("code")
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pos, token, run, code = state.get if state.exists else (None, None, 0, None)
        new = pd.concat(list(frames), ignore_index=True).sort_values("pos", kind="stable").drop_duplicates("pos")
        if pos is not None:
            new = new[new["pos"] > pos]
        if len(new):
            yield _counted(key[0], [CALLS], [CALLS], [len(new)])
            last = int(new["pos"].iloc[-1])
            real = new[new["token"].notna()]  # sandbox tokens have none
            if len(real):
                tokens, codes = real["token"].to_numpy(object), real["code"].to_numpy(np.int64)
                before = np.concatenate([[token], tokens[:-1]]).astype(object)
                place = np.arange(len(tokens))
                starts = np.maximum.accumulate(np.where(tokens != before, place, -1))
                # calls of the run up to here; a run carried over has ``run`` before this trigger
                length = np.where(starts < 0, place + 1 + run, place - starts + 1)
                kept = codes if max_repeats is None else codes[length <= max_repeats]
                path = kept if code is None else np.concatenate([[code], kept])
                if len(path) > 1:
                    steps, n = np.unique(np.stack([path[:-1], path[1:]], axis=1), axis=0, return_counts=True)
                    yield _counted(key[0], steps[:, 0], steps[:, 1], n)
                token, run, code = tokens[-1], int(length[-1]), int(codes[-1])
            state.update((last, token, run, code))
        if idle_ms is not None and state.exists:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return coded.groupBy("sample_id").applyInPandasWithState(follow, STEP_COLUMNS, STATE_COLUMNS, "append", timeout)


def _counted(sample, a, b, n) -> pd.DataFrame:
    size = len(n)
    return pd.DataFrame({"sample_id": [sample] * size, "a": np.asarray(a, np.int32), "b": np.asarray(b, np.int32), "n": np.asarray(n, np.int64)})


def store_steps(steps: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the steps of every trigger to ``path``, each once; ends with the calls that are there, or runs ``every`` so often.

    A stream that forgets idle samples has to run on: Spark never ends one that waits for time to pass.
    """
    writer = steps.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def score_steps(spark: SparkSession, steps: str, model: TransitionModel, vocab_size: int, output: str, checkpoint: str) -> StreamingQuery:
    """Add stored steps up by sample; each trigger writes the samples it changed under its batch number.

    The scores are those of whole samples, whatever the model's width.
    """
    rows = spark.readStream.schema(STEP_COLUMNS).parquet(steps)
    joined = rows.join(model.steps, ["a", "b"], "left").join(model.starts, "a", "left")
    unseen = F.lit(-math.log(vocab_size))
    # rows that count calls add nothing to a score
    gains = [
        F.sum(F.when(F.col("a") == CALLS, 0.0).otherwise(F.col("n") * (F.coalesce(F.get("base", F.lit(c)), unseen) + F.coalesce(F.get("gain", F.lit(c)), F.lit(0.0)))))
        for c in range(model.n_classes)
    ]
    calls = F.sum(F.when(F.col("a") == CALLS, F.col("n")).otherwise(0))
    sums = joined.groupBy("sample_id").agg(calls.alias("calls"), F.array(*gains).alias("scores"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, output: str) -> DataFrame:
    """(sample_id, calls, probs, y_pred): every sample's last scores; samples of fewer than two calls score all classes alike."""
    schema = "sample_id string, calls long, scores array<double>, batch int"
    try:
        rows = spark.read.schema(schema).parquet(output)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    newest = Window.partitionBy("sample_id").orderBy(F.desc("batch"))
    last = rows.withColumn("_at", F.row_number().over(newest)).where("_at = 1")
    e = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    total = F.aggregate("e", F.lit(0.0), lambda x, y: x + y)
    probs = last.withColumn("e", e).select("sample_id", "calls", F.transform("e", lambda x: x / total).alias("probs"))
    return probs.withColumn("y_pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
