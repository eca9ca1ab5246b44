"""Memoised calls of an injected text function: only prompts without a stored answer are sent, and only answers are stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X


def memo_key(provider: Column, model: Column, max_tokens: Column, system: Column, user: Column) -> Column:
    parts = (X.empty(c.cast("string")) for c in (provider, model, max_tokens, system, user))
    return F.sha2(F.concat_ws(chr(0x1F), *parts), 256)


def misses(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """Distinct requests whose key has no stored answer."""
    return requests.join(memo.select("key"), "key", "left_anti").dropDuplicates(["key"])


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written once and read back, so that no later step calls anything again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_answers(requests: DataFrame, memo: DataFrame, call: Callable[[str, str], str], tasks: int = 8, rounds: int = 3) -> DataFrame:
    """(key, response) of the requests (key, system, user) that the memo lacks. ``tasks`` bounds concurrent callers.

    A failed call is repeated while its error is worth it; a request that keeps failing or gets an empty answer has no row.
    """
    from quillon.functions.constants import RETRYABLE

    def run(batches):
        for pdf in batches:
            out = []
            for system, user in zip(pdf["system"], pdf["user"], strict=True):
                reply = None
                for _ in range(rounds):
                    try:
                        reply = call(system, user)
                        break
                    except Exception as e:  # noqa: BLE001 - any provider's error
                        said = f"{type(e).__name__} {e}".lower()
                        if not any(m in said for m in RETRYABLE):
                            break
                out.append(reply)
            yield pdf[["key"]].assign(response=out)

    new = misses(requests, memo).select("key", "system", "user").repartition(tasks, "key").mapInPandas(run, "key string, response string")
    return new.where(X.empty("response") != "")


def answer(requests: DataFrame, memo: DataFrame, call: Callable[[str, str], str], path: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(requests with ``response``, new memo rows). With a path the new rows are stored there before anything reads them."""
    new = new_answers(requests, memo, call, **how)
    new = stored(new, path) if path else new
    return requests.join(memo.select("key", "response").unionByName(new), "key", "left"), new
