"""Declared rules compiled to DataFrames: filters, joins and the latest row of each key."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OPERATORS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass
class Rule:
    """``conditions`` (column, operator, value); ``joins`` (other table, left column, right column);
    ``order_by`` (column, descending). With ``partition_by`` the first row of each key is kept."""

    table: str
    conditions: list[tuple[str, str, object]] = field(default_factory=list)
    joins: list[tuple[str, str, str]] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    select: list[str] = field(default_factory=list)


def run_rule(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """Conditions are pushed to the scans, the row limit of each key to the map side (window group limit)."""
    df = tables[rule.table]
    late = []
    for column, op, value in rule.conditions:
        if column in df.columns:
            df = df.where(_condition(column, op, value))
        else:
            late.append((column, op, value))
    for other, left, right in rule.joins:
        right_df = tables[other]
        for column, op, value in late:
            if column in right_df.columns:
                right_df = right_df.where(_condition(column, op, value))
        df = df.join(right_df, df[left] == right_df[right])
    if rule.partition_by:
        order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in rule.order_by]
        first = Window.partitionBy(*rule.partition_by).orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")
    return df.select(*rule.select) if rule.select else df


def _condition(column: str, op: str, value: object):
    name = op.strip().upper()
    if name == "IS NULL":
        return F.col(column).isNull()
    if name == "IS NOT NULL":
        return F.col(column).isNotNull()
    if name == "IN":
        return F.col(column).isin(*value)
    if name == "LIKE":
        return F.col(column).like(value)
    return _OPERATORS[name](F.col(column), F.lit(value))
