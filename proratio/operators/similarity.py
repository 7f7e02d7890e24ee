"""Likely counterparts of sheets and columns in other workbooks.

Workbooks are compared in the pairs asked for, so the work grows with the pairs.
Names are compared once per distinct pair, and only if their lengths and letters
allow the threshold.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from proratio.functions.text import normalize_name

SHEET_THRESHOLD, FIELD_THRESHOLD = 0.4, 0.5


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)])


def upper_bound(left: Column, right: Column) -> Column:
    """The similarity two texts cannot pass: letters they share, counted with repetition."""
    letters = F.array_distinct(F.split(left, ""))

    def times(text, letter):
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    shared = F.aggregate(
        letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(left, c), times(right, c)))
    )
    total = F.length(left) + F.length(right)
    return F.when(total == 0, 1.0).otherwise(shared * 2.0 / total)


def name_similarity(pairs: DataFrame, threshold: float) -> DataFrame:
    """Similarity of distinct normalised name pairs ``a, b`` that reach the threshold."""
    distinct = pairs.select("a", "b").distinct()
    possible = distinct.where(upper_bound(F.col("a"), F.col("b")) >= threshold)
    return possible.withColumn("similarity", sequence_ratio("a", "b")).where(F.col("similarity") >= threshold)


def confidence(similarity: Column, middle: float) -> Column:
    return F.when(similarity >= 0.85, "ALTA").when(similarity >= middle, "MEDIA").otherwise("BAIXA")


def sheet_matches(workbook_pairs: DataFrame, sheets: DataFrame) -> DataFrame:
    """Similar sheets of the two workbooks of each pair ``workbook_a, workbook_b``."""
    def side(s):
        return sheets.select(
            F.col("workbook_id").alias(f"workbook_{s}"), F.col("sheet_name").alias(f"sheet_{s}"), normalize_name(F.col("sheet_name")).alias(s)
        )

    both = workbook_pairs.join(side("a"), "workbook_a").join(side("b"), "workbook_b")
    return both.join(name_similarity(both, SHEET_THRESHOLD), ["a", "b"]).select(
        "workbook_a", "sheet_a", "workbook_b", "sheet_b", "similarity"
    )


def field_matches(matched: DataFrame, fields: DataFrame) -> DataFrame:
    """The best counterpart of each left column in each matched sheet; equal ones go to the earlier column."""
    named = fields.groupBy("workbook_id", "sheet_name", "field_name").agg(F.min("ordinal").alias("ordinal"))

    def side(s):
        return named.select(
            F.col("workbook_id").alias(f"workbook_{s}"), F.col("sheet_name").alias(f"sheet_{s}"), F.col("field_name").alias(f"field_{s}"),
            F.col("ordinal").alias(f"ordinal_{s}"), normalize_name(F.col("field_name")).alias(s),
        )

    sheets = matched.select("workbook_a", "sheet_a", "workbook_b", "sheet_b")
    both = sheets.join(side("a"), ["workbook_a", "sheet_a"]).join(side("b"), ["workbook_b", "sheet_b"])
    scored = both.join(name_similarity(both, FIELD_THRESHOLD), ["a", "b"])
    best = scored.groupBy("workbook_a", "sheet_a", "workbook_b", "sheet_b", "field_a").agg(
        F.max_by(F.struct("field_b", "similarity"), F.struct(F.col("similarity"), -F.col("ordinal_b"))).alias("m")
    )
    return best.select("workbook_a", "sheet_a", "workbook_b", "sheet_b", "field_a", "m.field_b", "m.similarity")


def cross_workbook_mapping(workbook_pairs: DataFrame, sheets: DataFrame, fields: DataFrame) -> DataFrame:
    """Sheet and column counterparts with their score, confidence and basis."""
    matched = sheet_matches(workbook_pairs, sheets)
    found = matched.select(
        "workbook_a", "sheet_a", "workbook_b", "sheet_b", F.lit("").alias("field_a"), F.lit("").alias("field_b"), "similarity",
        confidence(F.col("similarity"), 0.6).alias("confidence"), F.lit("nome_da_aba").alias("basis"),
    )
    columns = field_matches(matched, fields)
    found = found.unionByName(
        columns.withColumn("confidence", confidence(F.col("similarity"), 0.65)).withColumn("basis", F.lit("nome_de_campo"))
    )
    return found.withColumn("similarity_score", F.round("similarity", 2)).drop("similarity")
