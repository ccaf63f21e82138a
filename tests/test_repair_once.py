"""Markdown is repaired in one pass: what several rules look at is computed once, not anew for each."""

from pyspark.sql import functions as F

from gazeloom.functions import text as X


def test_lines_are_cut_and_stripped_once(spark):
    plan = X.repair_markdown(F.col("c"))._jc.toString()
    assert plan.count("split(") == 1
    assert X._line_kind(F.col("c"))._jc.toString().count("regexp_replace(") == X.strip(F.col("c"))._jc.toString().count("regexp_replace(")
