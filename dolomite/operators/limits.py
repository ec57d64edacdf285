"""Limits on calls that hold over a whole job: one budget shared by all workers, and a block that outlives them.

asked_together runs as a barrier stage. In each window of time the workers tell each other what they would ask next and until when a
provider refused them; all divide the window's calls and tokens the same way, so that together they never exceed them. A refusal seen by one
worker stops all. asked_in_blocks deals a long job to blocks of bounded size, writes each block's answers before it begins the next, and
so loses no more than a block to a failure; a refusal is read off the written answers, so it holds for later blocks and later runs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dolomite.functions.text import unused
from dolomite.sources.writers import new_folder
from dolomite.operators.provider import Provider, seconds_to_wait


@dataclass(frozen=True)
class Limit:
    """At most so many calls, and tokens (about four characters each, and one a call), in each window of seconds.

    least: seconds for which a refusal for the day holds at least.
    """

    calls: int
    seconds: float = 60.0
    tokens: int | None = None
    least: float = 300.0

    def cost(self, text: str | None) -> int:
        return len(text or "") // 4 + 1


def shares(limit: Limit, wanted: Sequence[Sequence[int]]) -> list[int]:
    """How many of its next calls (their costs) each worker may make in a window: one each in turn while calls and tokens last.

    A call that costs more than a whole window's tokens has a window for itself, or none would ever make it.
    """
    given, calls, tokens = [0] * len(wanted), limit.calls, limit.tokens if limit.tokens is not None else float("inf")
    open_ = {i for i, w in enumerate(wanted) if w}
    while open_ and calls > 0:
        for i in sorted(open_):
            cost = wanted[i][given[i]]
            alone = not any(given)
            if calls < 1 or (cost > tokens and not (alone and cost > (limit.tokens or 0))):
                open_.discard(i)
                continue
            given[i], calls, tokens = given[i] + 1, calls - 1, tokens - cost
            if given[i] == len(wanted[i]):
                open_.discard(i)
    return given


def refused_until(message: str, limit: Limit, now: float) -> float:
    """When the day's tokens are there again, by the provider's message; 0 for other errors."""
    if "429" in message and "tokens per day" in message:
        return now + max(limit.least, seconds_to_wait(message, limit.least + 5) - 5)
    return 0.0


def asked_together(rows: DataFrame, provider: Provider, task: str, limit: Limit, text_col: str = "chunk", workers: int = 2, answer: str = "answer", error: str = "error", until: str = "refused_until", refused: float = 0.0) -> DataFrame:
    """rows with the provider's answer or an error, and the time until which it refused (0: it did not). workers: tasks, which run at once.

    refused: the time of a refusal known before. What is left when a refusal comes is not asked, and says so in its error.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context, held, blocked = BarrierTaskContext.get(), None, refused
        place, batches, own = 0, iter(batches), []

        def told(message: dict) -> list[dict]:
            return [json.loads(x) for x in context.allGather(json.dumps(message))]

        while True:
            while held is None or place >= len(held):
                if held is not None:
                    yield held.assign(**{answer: [a for a, _, _ in own], error: [e for _, e, _ in own], until: [u for _, _, u in own]})
                held, place, own = next(batches, None), 0, []
                if held is None:
                    break
            ahead = [] if held is None else [limit.cost(t) for t in held[text_col].iloc[place : place + limit.calls]]
            every = told({"wants": ahead, "refused": blocked, "now": time.time()})
            blocked = max(x["refused"] for x in every)
            if not any(x["wants"] for x in every):
                return
            if blocked > time.time():
                left = [] if held is None else [(None, "not asked: the provider refuses calls", blocked)] * (len(held) - place)
                own, place = own + left, place + len(left)
                continue
            began = max(x["now"] for x in every)
            for _ in range(shares(limit, [x["wants"] for x in every])[context.partitionId()]):
                try:
                    own.append((provider.complete(task, held[text_col].iloc[place] or ""), None, 0.0))
                except Exception as e:  # noqa: BLE001  a failed call fails no task
                    blocked = max(blocked, refused_until(str(e), limit, time.time()))
                    own.append((None, str(e), blocked if blocked > time.time() else 0.0))
                place += 1
                if blocked > time.time():
                    break
            # The next window begins when this one is over for all.
            time.sleep(max(0.0, began + limit.seconds - time.time()))

    return rows.repartition(workers).mapInPandas(run, f"{fields}, `{answer}` string, `{error}` string, `{until}` double", barrier=True)


def asked_in_blocks(rows: DataFrame, provider: Provider, task: str, limit: Limit, folder: str, keys: Sequence[str] = ("document_id", "chunk_index"), text_col: str = "chunk", workers: int = 2, block_rows: int = 1000) -> DataFrame:
    """rows with answer and error, asked block by block into `folder`; started again it goes on behind the last block written.

    Rows that were refused, and those not asked for it, are asked again by a later run, once the time of the refusal has passed: the answers
    of a run are one table, runs are numbered, and an answer hides the errors before it. Repeated rows of equal keys are asked once.
    """
    spark = rows.sparkSession
    (run, part) = unused(rows, "run", "block")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, answer string, error string, refused_until double, `{run}` int, `{part}` int"

    def done() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{folder}/run=*/block=*")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    known = done()
    state = known.agg(F.max(run).alias("run"), F.max("refused_until").alias("until")).first()
    refused, last = state["until"] or 0.0, -1 if state["run"] is None else state["run"]
    left = rows.dropDuplicates([*keys]).join(known.where("answer is not null or refused_until = 0").select(*keys), [*keys], "left_anti")
    blocks = -(-left.count() // block_rows)
    # Dealt to blocks once, by folders: a block reads its own rows alone.
    dealt = new_folder(spark, "blocks-to-ask")
    left.withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(max(blocks, 1))).cast("int")).write.partitionBy(part).parquet(dealt)
    for k in range(blocks):
        path = f"{folder}/run={last + 1}/block={k}"
        own = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{part}` int").parquet(dealt).where(F.col(part) == k).drop(part)
        asked = asked_together(own, provider, task, limit, text_col, workers, "answer", "error", "refused_until", refused)
        asked.withColumns({run: F.lit(last + 1), part: F.lit(k)}).write.mode("overwrite").parquet(path)
        refused = max(refused, spark.read.schema(schema).parquet(path).agg(F.max("refused_until")).first()[0] or 0.0)
        if refused > time.time():
            break  # the rest waits for a later run
    best = done().groupBy(*keys).agg(F.max_by(F.struct("answer", "error"), F.struct(F.col("answer").isNotNull(), run)).alias(run))
    return rows.join(best, [*keys], "left").select(*rows.columns, f"{run}.answer", f"{run}.error")
