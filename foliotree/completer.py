"""The model step: one response per request, in batch.

``attach`` takes rows with ``system`` and ``prompt`` and returns them with a
nullable ``response`` in their place. A null prompt asks for nothing and gets null. What a null
or unusable response means is the business of the operator that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from foliotree.functions.durable import cut
from foliotree.functions.skew import hot_counts, join_hot, shuffle_width

RESPONSE_SCHEMA = "request_id string, response string"

# Requests that a task works on at once.
SLICE = 64


class Completer(Protocol):
    def attach(self, requests: DataFrame) -> DataFrame: ...


def with_request_id(requests: DataFrame) -> DataFrame:
    """Equal requests get equal ids, so a page copied a million times is asked for once."""
    return requests.withColumn(
        "request_id", F.when(F.col("prompt").isNotNull(), F.sha2(F.concat_ws("\n", "system", "prompt"), 256))
    )


def distinct_requests(requests: DataFrame) -> DataFrame:
    """(request_id, system, prompt, copies), one row per request; copies are combined before the shuffle."""
    return with_request_id(requests).where(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.first("system").alias("system"), F.first("prompt").alias("prompt"), F.count("*").alias("copies")
    )


class NullCompleter:
    """No model: every response is null and every operator takes its deterministic branch."""

    def attach(self, requests: DataFrame) -> DataFrame:
        return requests.drop("system", "prompt").withColumn("response", F.lit(None).cast("string"))


def asks(completer: Completer | None) -> bool:
    """False where no model is there: the plans then leave out prompts and parsing altogether."""
    return completer is not None and not isinstance(completer, NullCompleter)


class TableCompleter:
    """Responses of an earlier run: (request_id, response), unique by request_id.

    ``copies`` (request_id, copies) tells how often each request occurs, if known.
    """

    def __init__(self, responses: DataFrame, copies: DataFrame | None = None) -> None:
        self.responses = responses.select("request_id", "response")
        self.copies = copies

    def attach(self, requests: DataFrame) -> DataFrame:
        asked = with_request_id(requests).drop("system", "prompt")
        spread = [c for c in requests.columns if c not in ("system", "prompt")]
        hot = None
        if self.copies is not None:
            counts = self.copies.select("request_id", F.col("copies").alias("__n"))
            hot = hot_counts(counts, "request_id", shuffle_width(requests))
        return join_hot(asked, self.responses, "request_id", spread, "left", hot).drop("request_id")


class FunctionCompleter:
    """Call a client from the tasks, one client per partition; a failing call gives null and its reason.

    ``make_client()`` runs on the executor and returns ``client(system, prompt) -> str``,
    which up to ``parallel`` threads of a task call at once. Requests go to a task
    in slices of ``SLICE`` rows, whatever the size of Arrow batches.
    The responses are checkpointed, so the several readers of one answer and the
    retry of a lost task downstream never call the model again. ``failed``
    (request_id, error) has the failures of the last :meth:`attach`.
    """

    def __init__(self, make_client: Callable[[], Callable[[str, str], str | None]], partitions: int | None = None,
                 parallel: int = 8) -> None:
        self.make_client = make_client
        self.partitions = partitions
        self.parallel = parallel
        self.failed: DataFrame | None = None

    def complete(self, unique: DataFrame) -> DataFrame:
        """(request_id, response, error, copies) of distinct requests."""
        make_client, parallel = self.make_client, self.parallel

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make_client()

            def ask(system: str, prompt: str) -> tuple[str | None, str | None]:
                try:
                    response = client(system, prompt)
                    return response, None if response is not None else "no response"
                except Exception as e:
                    return None, f"{type(e).__name__}: {e}"

            with ThreadPoolExecutor(parallel) as pool:
                for batch in batches:
                    for at in range(0, len(batch), SLICE):
                        part = batch.iloc[at : at + SLICE]
                        answers = list(pool.map(ask, part["system"], part["prompt"]))
                        yield pd.DataFrame({
                            "request_id": part["request_id"].array, "response": pd.Series([a for a, _ in answers], dtype=object),
                            "error": pd.Series([e for _, e in answers], dtype=object), "copies": part["copies"].array,
                        })

        # Distinct requests come hashed by their id, which evens out the calls whatever documents they are from.
        spread = unique.repartition(self.partitions, "request_id") if self.partitions else unique
        return spread.mapInPandas(run, RESPONSE_SCHEMA + ", error string, copies long")

    def attach(self, requests: DataFrame) -> DataFrame:
        responses = cut(self.complete(distinct_requests(requests)))
        self.failed = responses.where(F.col("error").isNotNull()).select("request_id", "error")
        return TableCompleter(responses, responses).attach(requests)


class StoredCompleter:
    """A FunctionCompleter that keeps its responses at ``path`` and asks only for those not there yet.

    Requests are answered and committed in ``commits`` slices by their id, so a job
    that dies has lost one slice at most.
    """

    def __init__(self, inner: FunctionCompleter, path: str, commits: int = 1) -> None:
        self.inner = inner
        self.path = path
        self.commits = commits

    def _stored(self, requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        try:
            return spark.read.schema(RESPONSE_SCHEMA).parquet(self.path)
        except AnalysisException:
            return spark.createDataFrame([], RESPONSE_SCHEMA)

    def attach(self, requests: DataFrame) -> DataFrame:
        missing = distinct_requests(requests).join(self._stored(requests), "request_id", "left_anti")
        missing = cut(missing) if self.commits > 1 else missing
        for k in range(self.commits):
            part = missing if self.commits == 1 else missing.where(F.pmod(F.xxhash64("request_id"), F.lit(self.commits)) == k)
            answered = self.inner.complete(part).where(F.col("response").isNotNull())
            answered.select("request_id", "response").write.mode("append").parquet(self.path)
        return TableCompleter(self._stored(requests)).attach(requests)
