"""Users' functions over items."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .expr import LOCAL_FAULTS, PERMANENT

RESULT = "subjob_id string, status string, error string, metrics string, attempts int"


def map_items(items: DataFrame, fn: Callable[[dict], dict | None], retries: int = 2, backoff: float = 0.5) -> DataFrame:
    """Runs fn(spec) for each item: status, error, metrics as JSON, and the attempts it took.

    A failure is tried again after backoff * 2^n seconds, unless its text is permanent; an exception is a failure. No
    status means ok. Spark runs lost tasks again, so fn must bear being called twice. A null or broken spec is {}.
    """

    def once(spec: dict) -> tuple[str, str | None, dict]:
        try:
            got: dict[str, Any] = fn(spec) or {}
        except Exception as e:  # a user's function may raise anything; the item fails, not the job
            return "error", f"{type(e).__name__}: {e}", {}
        status, metrics = got.get("status") or "ok", got.get("metrics") or {}
        error = got.get("error") or metrics.get("traceback") or metrics.get("error") or metrics.get("reason")
        return status, (error or "no error text") if status == "error" else error, metrics

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["subjob_id"], batch["spec"], strict=True):
                try:
                    spec = json.loads(text) if text else {}
                except ValueError:
                    spec = {}
                for n in range(retries + 1):
                    status, error, metrics = once(spec)
                    low = (error or "").lower()
                    final = any(p in low for p in PERMANENT) and low.strip() not in LOCAL_FAULTS
                    if status != "error" or final or n == retries:
                        break
                    time.sleep(backoff * 2**n)
                rows.append((key, status, error, json.dumps(metrics, sort_keys=True, default=str), n + 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return items.select("subjob_id", "spec").mapInPandas(run, RESULT)


def enumerate_items(args: DataFrame, fn: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """The items that fn yields for each row of arguments: subjob_id and spec; the row's columns reach fn as a dict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i.get("subjob_id") or i.get("job_id"), json.dumps(i.get("spec") or {}, sort_keys=True)) for r in batch.to_dict("records") for i in fn(r)]
            yield pd.DataFrame(rows, columns=["subjob_id", "spec"])

    return args.mapInPandas(run, "subjob_id string, spec string")


#: The hooks by which a task fans out its items: today's name, and the one it had before.
HOOKS = ("enumerate_subjobs", "enumerate_gigs")


def _enumerator(task: Any) -> type:
    hook = next((getattr(task, name) for name in HOOKS if callable(getattr(task, name, None))), None)
    if hook is None:
        raise ValueError(f"a task enumerates its items by a function {' or '.join(HOOKS)}")

    class Enumerate:
        """Arguments as a JSON object, to one row for each item; a null or broken object is {}."""

        @staticmethod
        def analyze(args: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(StructType().add("subjob_id", "string").add("spec", "string"))

        def eval(self, args: str) -> Iterator[tuple[str, str]]:
            try:
                given = json.loads(args) if args else {}
            except ValueError:
                given = {}
            for item in hook(given):
                yield item.get("subjob_id") or item.get("job_id"), json.dumps(item.get("spec") or {}, sort_keys=True)

    return Enumerate


def register_enumerator(spark: SparkSession, name: str, task: Any) -> None:
    """A task (a module or class with one of the HOOKS) as a table function of SQL: FROM t, LATERAL name(to_json(...))."""
    spark.udtf.register(name, F.udtf(_enumerator(task)))


def fan_out(args: DataFrame, task: Any) -> DataFrame:
    """The columns of each row of arguments beside the items (subjob_id, spec) that the task makes of it."""
    given = F.to_json(F.struct(*(F.col(c).outer().alias(c) for c in args.columns)))
    return args.lateralJoin(F.udtf(_enumerator(task))(given))
