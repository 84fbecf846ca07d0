"""Checks that are made while a load writes, as observed metrics of that one job: no further scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weblake.operators.quality import too_long
from weblake.schema import DIMENSIONS, FACT_NOT_NULL, FACT_TABLE

CHECK_SCHEMA = "check string, subject string, violations bigint"


class LoadChecks:
    """Attach :meth:`of_stage` and :meth:`of_fact` to what a job reads and writes; after it, :meth:`rows` holds the counts.

    Checked are nulls in columns that must not hold any, texts beyond their limit in bytes, and rows that found no id in
    some dimension and so were lost between stage and fact table.
    """

    def __init__(self):
        self.stage, self.fact = Observation(), Observation()

    def of_stage(self, stage: DataFrame) -> DataFrame:
        long = [F.count_if(too_long(d.stage_column, d.limit)).alias(d.stage_column) for d in DIMENSIONS.values()]
        return stage.observe(self.stage, F.count(F.lit(1)).alias("_rows"), *long)

    def of_fact(self, fact: DataFrame) -> DataFrame:
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in FACT_NOT_NULL]
        return fact.observe(self.fact, F.count(F.lit(1)).alias("_rows"), *nulls)

    def rows(self) -> list[tuple[str, str, int]]:
        """(check, subject, violations) of every check, once the observed job has run."""
        stage, fact = dict(self.stage.get), dict(self.fact.get)
        lost = stage.pop("_rows") - fact.pop("_rows")
        lengths = [("length", c, n) for c, n in stage.items()]
        return [*lengths, *(("null", c, n) for c, n in fact.items()), ("lost rows", FACT_TABLE, lost)]
