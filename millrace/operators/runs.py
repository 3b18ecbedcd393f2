"""A run over several sources that is written and measured in one job, in which a source that fails is told and costs the others nothing.

Each source's rows pass an observation on their way to the writer, so counts come with the write and no source is read twice. Sources are few, those of one
configuration; each adds a branch to the union. A source whose frame can't be made is told at once. If the write fails, each source is tried alone (without a sink, so nothing is kept of
it), those that fail are told and left out, and the others are written in one job again: the only case in which rows are read twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rounds import materialise
from millrace.operators import health

RUN = "source string, queries int, raw_count long, duration_s double, error string"


def _told(e: Exception) -> str:
    text = str(e).strip().splitlines()
    return f"{type(e).__name__}: {text[0] if text else ''}".rstrip(": ")


def _counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def run(
    spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], queries: dict[str, int] | None = None, name: str = "run", write: Callable[[DataFrame, str], DataFrame] = materialise,
) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all ``sources`` that work, as ``write`` gives them back (None if none works), and a row for each source for the run history (``RUN``).

    The sources' frames need the same columns. The seconds of a source are those of making its frame, and a share of the job's by its rows.
    """
    frames: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    made: dict[str, float] = {}
    for source, make in sources.items():
        began = time.monotonic()
        try:
            frames[source] = make()
            frames[source].schema  # what can't be resolved is told here
        except Exception as e:  # noqa: BLE001  a source may fail in any way, and is told
            errors[source] = _told(e)
            frames.pop(source, None)
        made[source] = time.monotonic() - began
    out, seen, took = None, {}, 0.0
    for last in (False, True):
        watched = {s: _counted(f) for s, f in frames.items()}
        seen = {s: o for s, (_, o) in watched.items()}
        if not watched:
            break
        began = time.monotonic()
        try:
            out = write(reduce(lambda a, b: a.unionByName(b), [f for f, _ in watched.values()]), name)
            took = time.monotonic() - began
            break
        except Exception:  # noqa: BLE001
            failed = {} if last else {s: e for s, f in frames.items() if (e := _alone(f))}
            if not failed:
                raise
            errors |= failed
            frames = {s: f for s, f in frames.items() if s not in failed}
    counts = {s: (o.get["n"] if out is not None else 0) for s, o in seen.items()}
    total = sum(counts.values()) or 1
    rows = [(s, (queries or {}).get(s, 0), counts.get(s, 0), round(made[s] + took * counts.get(s, 0) / total, 2), errors.get(s)) for s in sources]
    return out, spark.createDataFrame(rows, RUN)


def _alone(frame: DataFrame) -> str | None:
    try:
        frame.write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001
        return _told(e)
    return None


def recorded(history: DataFrame, run_: DataFrame, run_at, stale_runs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The history with the run, and the sources that have recovered with it, judged against the history before."""
    now = run_.withColumn("run_at", run_at)
    return health.record(history, now), health.recovered(history, now, stale_runs)
