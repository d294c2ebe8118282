"""Page checks written as Python functions, each judged apart from all others.

A function sees one page's features as a dict and returns ``(severity, conclusion)``, or ``None`` for
no row. If it raises, or returns something else, that page has no result of this check and an error
row instead; all other checks and pages stay as they are. Pages stay where they are: there is no
shuffle, and only the columns that the checks name go to Python, in Arrow batches.

Checks in columns (``page_checks.register_check``) are the faster way. Their errors show when the
plan is made, see ``usable_checks``; expressions that may fail on a value use ``try_*`` functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from auditlake.operators.profiles import KEYS

SEVERITIES = ("pass", "warn", "fail", "info")
OUTCOME = ["severity", "conclusion", "error"]
ERROR_CHARS = 500


@dataclass(frozen=True)
class RowCheck:
    """A check of single pages: ``judge`` gets a dict of the feature columns named in ``columns``."""

    check_id: str
    category: str
    title: str
    columns: tuple[str, ...]
    judge: Callable[[dict], tuple[str, str] | None]
    fix: str | None = None


def _outcome(check: RowCheck, row: dict) -> tuple[str | None, str | None, str | None] | None:
    try:
        said = check.judge({c: row[c] for c in check.columns})
        if said is None:
            return None
        severity, conclusion = said
        if severity not in SEVERITIES or not isinstance(conclusion, str):
            raise ValueError(f"not a result: {said!r}")
        return severity, conclusion, None
    except Exception as e:  # noqa: BLE001 - whatever a check raises is that check's result for the page
        return None, None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]


def judged_rows(features: DataFrame, checks: Iterable[RowCheck]) -> DataFrame:
    """``KEYS, nth, severity, conclusion, error`` per page and check; ``nth`` is the check's place.

    Nulls in features reach the functions as ``None``. Without pages, or without checks, there are no rows.
    """
    checks = tuple(checks)
    if len({c.check_id for c in checks}) < len(checks):
        raise ValueError("two checks have the same id")
    wanted = list(dict.fromkeys(c for check in checks for c in check.columns if c not in KEYS))
    narrow = features.select(*KEYS, *wanted)
    out = StructType(narrow.schema.fields[: len(KEYS)]).add("nth", LongType())
    for name in OUTCOME:
        out = out.add(name, StringType())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nth, outcomes = [], [], []
            for i, row in enumerate(batch.to_pylist()):
                for n, check in enumerate(checks):
                    outcome = _outcome(check, row)
                    if outcome is not None:
                        at.append(i)
                        nth.append(n)
                        outcomes.append(outcome)
            keys = batch.select(KEYS).take(pa.array(at, pa.int64()))
            said = [pa.array([o[j] for o in outcomes], pa.string()) for j in range(len(OUTCOME))]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(nth, pa.int64()), *said], names=[*KEYS, "nth", *OUTCOME])

    return narrow.mapInArrow(judge, out)


def split_outcomes(judged: DataFrame, checks: Iterable[RowCheck], first_ord: int = 0) -> tuple[DataFrame, DataFrame]:
    """Check rows like those of ``page_checks``, and error rows ``(KEYS, check_id, error)``.

    Both read ``judged``; stage it first where the functions are dear. ``first_ord`` is the place of
    the first check behind those that the rows are joined to.
    """
    checks = tuple(checks) or (RowCheck("", "", "", (), lambda row: None),)

    def of(field: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(c, field)).cast("string") for c in checks]), F.col("nth").cast("int"))

    named = judged.select(
        "*", of("check_id").alias("check_id"), of("category").alias("category"), of("title").alias("title"), of("fix").alias("hint")
    )
    results = named.where(F.col("error").isNull()).select(
        *[F.col(k).alias("page_url" if k == "url" else k) for k in KEYS],
        (F.col("nth") + first_ord).cast("int").alias("source_ord"),
        "check_id", "category", "severity", "title",
        F.concat("title", F.lit(": "), "conclusion").alias("message"),
        F.when(F.col("severity").isin("warn", "fail"), F.col("hint")).alias("fix"),
        "conclusion",
        F.create_map().cast("map<string,string>").alias("details"),
    )
    return results, named.where(F.col("error").isNotNull()).select(*KEYS, "check_id", "error")


def usable_checks(features: DataFrame, builders: dict[str, Callable[[], Column]]) -> tuple[dict[str, Callable[[], Column]], dict[str, str]]:
    """Checks in columns that can be planned over ``features``, and what is wrong with the others.

    Only plans are made, nothing is read.
    """
    usable, errors = {}, {}
    for check_id, build in builders.items():
        try:
            features.select(build()["severity"]).schema
            usable[check_id] = build
        except (PySparkException, ArithmeticError, AttributeError, LookupError, TypeError, ValueError) as e:
            errors[check_id] = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
    return usable, errors
