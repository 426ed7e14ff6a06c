"""Step-wise reconstruction: an income moved until a benefit is met."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ("matched", "passed", "empty", "not solved")


def walked(income: np.ndarray, target: np.ndarray, recorded: np.ndarray, benefit: Callable, *, step: float, near: float, most: int) -> tuple[np.ndarray, ...]:
    """Steps, income, reached benefit and number of the reason of many cases: rounds over the cases still open."""
    income, now = income.copy(), benefit(income, np.arange(len(income)))
    steps, reason = np.zeros(len(income), np.int64), np.full(len(income), 3)
    up = target > recorded
    # What can't be compared can't end: it isn't opened.
    open_ = np.flatnonzero(~np.isnan(target + recorded + now))
    while len(open_):
        goal, got, amount, rises = target[open_], now[open_], income[open_], up[open_]
        ends = [np.abs(goal - got) <= near, np.where(rises, got > goal, got < goal), np.where(rises, amount <= 0, got <= 0)]
        reason[open_] = np.select(ends, [0, 1, 2], 3)
        open_ = open_[(reason[open_] == 3) & (steps[open_] < most)]
        income[open_] = np.where(up[open_], np.maximum(income[open_] - step, 0.0), income[open_] + step)
        steps[open_] += 1
        now[open_] = benefit(income[open_], open_)
    return steps, income, now, reason


def walk(df: DataFrame, key: str, income: str, target: str, recorded: str, given: list[str], benefit: Callable, *, step: float = 3.0, near: float = 3.0, most: int = 1000) -> DataFrame:
    """(key, start, steps, income, reached, reason): ``income`` moved in steps until ``benefit`` of it meets ``target``.

    A target above the ``recorded`` benefit lowers the income, never under 0; one below raises it. A case ends
    'matched' within ``near`` of its target, 'passed' beyond it, 'empty' where the income to be lowered or the
    benefit to be lowered is used up, and is 'not solved' after ``most`` steps. ``benefit`` takes incomes and a
    dictionary of the ``given`` columns' values; a batch's cases step together, those that ended drop out. Cases
    with a null among these columns are 'not solved' after 0 steps, with a null income and benefit.
    """
    names = [income, target, recorded, *given]
    schema = f"key {df.schema[key].dataType.simpleString()}, start double, steps long, income double, reached double, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {n: b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i, n in enumerate(names)}
            paid = lambda amount, rows, x=x: benefit(amount, {n: x[n][rows] for n in given})
            steps, after, now, reason = walked(x[income], x[target], x[recorded], paid, step=step, near=near, most=most)
            unknown = np.isnan(np.stack([x[n] for n in names])).any(0)
            steps[unknown], reason[unknown] = 0, 3
            columns = [pa.array(x[income], mask=np.isnan(x[income])), pa.array(steps), pa.array(after, mask=unknown), pa.array(now, mask=unknown), pa.array(np.array(REASONS)[reason])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["key", "start", "steps", "income", "reached", "reason"])

    return df.select(key, *[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(run, schema).withColumnRenamed("key", key)
