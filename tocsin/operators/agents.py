"""Ask a model about every prompt of a table.

The model is a function of the caller: it takes a list of prompts and returns,
for each, ``(text, prompt_tokens, completion_tokens)`` or an exception.  Spark
hands it Arrow batches, so calls run in parallel over partitions, and everything
around the call (cleaning, validation, choice of attempt) is DataFrame work on
the attempts table this returns.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tocsin import schemas
from tocsin.operators.answers import ATTEMPTS
from tocsin.session import ship
from tocsin.sources.ranges import system_of

Reply = tuple[str | None, int, int]
Model = Callable[[list[str]], "list[Reply | Exception]"]

# Failures worth another attempt; any other ends the prompt's attempts.
RETRIED = (ConnectionError, ValueError)
# Start of ``error`` where the failure ended the attempts.
FINAL = "final: "


def worth_another() -> Column:
    """Whether an attempt's failure, if any, allows another attempt."""
    return ~F.coalesce(F.startswith("error", F.lit(FINAL)), F.lit(False))


def _asker(model: Model, fallback: Model | None, accept, attempts: int, first: int = 1):
    """The function that asks about a batch of prompts and yields its attempts, numbered from ``first``."""
    # Plain values, so that the shipped function needs no module of this package.
    columns, retried, last = list(schemas.ATTEMPT.names), RETRIED, FINAL

    def replies(ask: Model | None, texts: list[str]) -> list[Reply | Exception]:
        if ask is None or not texts:
            return [(None, None, None)] * len(texts)
        try:
            return ask(texts)
        except Exception as failure:  # one failed batch call fails its prompts
            return [failure] * len(texts)

    def run(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        open_rows = batch[["incident_id", "agent", "prompt"]]
        for attempt in range(first, first + attempts):
            if open_rows.empty:
                break
            rows, again = [], []
            start = time.perf_counter()
            primary = replies(model, list(open_rows["prompt"]))
            unanswered = [n for n, reply in enumerate(primary) if isinstance(reply, Exception) or not reply[0]]
            second = dict(zip(unanswered, replies(fallback, [open_rows["prompt"].iat[n] for n in unanswered])))
            ms = (time.perf_counter() - start) * 1000 / len(open_rows)
            for n, (incident, agent, prompt) in enumerate(open_rows.itertuples(index=False)):
                one, two = primary[n], second.get(n, (None, None, None))
                # A failed primary leads to the fallback; only the fallback's
                # own failure can be one that is not worth another attempt.
                failure = next((r for r in (two, one) if isinstance(r, Exception)), None)
                final = isinstance(two, Exception) and not isinstance(two, retried)
                one = (None, 0, 0) if isinstance(one, Exception) else one
                two = (None, None, None) if isinstance(two, Exception) else two
                text = one[0] or two[0]
                error = failure and (last if final else "") + repr(failure)
                rows.append((incident, agent, attempt, prompt, *one, *two, ms, error))
                good = bool(text) and (accept is None or accept(agent, text))
                again.append(not good and not final)
            yield pd.DataFrame(rows, columns=columns)
            open_rows = open_rows[again]

    return run


def attempt_type(prompts: DataFrame) -> T.StructType:
    """Rows of attempts whose incidents are named as in ``prompts``."""
    return T.StructType([prompts.schema["incident_id"], *schemas.ATTEMPT.fields[1:]])


def ask_model(
    prompts: DataFrame,
    model: Model,
    fallback: Model | None = None,
    accept: Callable[[str, str], bool] | None = None,
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Attempts table for prompts with columns incident_id, agent and prompt.

    ``accept(agent, text)`` may end the attempts of a prompt early; without it a
    non-empty text does.  A failed or refused prompt is asked again, up to
    ``attempts`` times, and every attempt is a row.  Spark may run a task twice,
    so write the result to a table before joining it to anything.  To ask
    nothing twice see ``ask_once``, and to repeat answers that break an agent's
    rules ``tocsin.plans.triage.run_agents``.
    """
    ask = _asker(model, fallback, accept, attempts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from ask(batch)

    return prompts.select("incident_id", "agent", "prompt").mapInPandas(run, attempt_type(prompts))


def prompt_hash() -> Column:
    return F.sha2("prompt", 256).alias("prompt_hash")


def ask_once(
    prompts: DataFrame,
    model: Model,
    journal: str,
    fallback: Model | None = None,
    attempt: int = 1,
    batch: int = 256,
    concurrency: int | None = None,
) -> DataFrame:
    """One attempt for every prompt; what ``journal`` holds already is not asked again.

    The journal is a folder of one agent and attempt.  Prompts go to the model
    ``batch`` at a time, in at most ``concurrency`` calls at once (by default
    as many as Spark has cores), and the replies of a call are added to the journal, as a
    file that appears whole, before the next call.  So a run that breaks off,
    and a task that Spark repeats, lose one unfinished call per task at most.  A
    prompt is known by its incident and its text: one that has changed is asked.
    """
    ship(prompts.sparkSession)
    spark, kind = prompts.sparkSession, attempt_type(prompts)
    system, place = system_of(journal)
    system.create_dir(place, recursive=True)
    ask, arrow = _asker(model, fallback, None, 1, attempt), to_arrow_schema(kind)
    key = ["incident_id", "prompt_hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = system_of(journal)
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                name = hashlib.sha256(repr(list(zip(part["incident_id"], part["prompt_hash"]))).encode()).hexdigest()
                if system.get_file_info(f"{place}/{name}.parquet").type == fs.FileType.NotFound:
                    told = pa.Table.from_pandas(pd.concat(ask(part)), arrow, preserve_index=False)
                    hidden = f"{place}/.{name}-{uuid.uuid4().hex}"
                    with system.open_output_stream(hidden) as file:
                        pq.write_table(told, file)
                    system.move(hidden, f"{place}/{name}.parquet")
            yield rows[["incident_id"]]

    known = spark.read.schema(kind).parquet(journal).select("*", prompt_hash())
    asked = prompts.select("incident_id", "agent", "prompt", prompt_hash()).dropDuplicates(key)
    tasks = concurrency or spark.sparkContext.defaultParallelism
    waiting = asked.join(known, key, "left_anti").repartition(tasks)
    waiting.mapInPandas(run, T.StructType([kind["incident_id"]])).count()
    known = spark.read.schema(kind).parquet(journal).select("*", prompt_hash()).dropDuplicates(key)
    return known.join(prompts.select("incident_id", prompt_hash()), key, "left_semi").drop("prompt_hash")
