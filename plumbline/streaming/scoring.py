"""Continuous scoring of a payload stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.contract import Contract, split_valid, validate
from plumbline.streaming.runtime import for_each_batch, write_batch


def decide(probability: Column, threshold: float) -> dict[str, Column]:
    hit = probability >= threshold
    return {
        "prediction": hit.cast("int"),
        "threshold": F.lit(threshold),
        "decision": F.when(hit, "yes").otherwise("no"),
    }


def score_stream(
    payloads: DataFrame,
    contract: Contract,
    scorer: Callable[[DataFrame], DataFrame],
    threshold: float,
    root: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Validate, score and append payload rows; bad ones go to quarantine with their errors.

    ``scorer`` adds a ``probability`` column (for example a fitted model's
    transform). Output: ``root/scored`` and ``root/quarantine``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = validate(batch, contract).persist()
        good, bad = split_valid(checked)
        write_batch(scorer(good).withColumns(decide(F.col("probability"), threshold)), f"{root}/scored", batch_id)
        write_batch(bad, f"{root}/quarantine", batch_id)
        checked.unpersist()

    return for_each_batch(payloads, handle, checkpoint)
