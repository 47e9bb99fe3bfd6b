"""Boolean rules over 0/1 columns as classifiers."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(expression: str) -> tuple[list[str], str]:
    """Names and the operation of "A AND B" or "A OR B OR C"; mixed or missing operators are errors."""
    has = [op for op in ("AND", "OR") if f" {op} " in expression]
    if len(has) != 1:
        raise ValueError(f"exactly one of AND, OR is needed: {expression!r}")
    names = [n.strip() for n in expression.split(f" {has[0]} ")]
    if not all(names):
        raise ValueError(f"an empty name: {expression!r}")
    return names, has[0]


def kind(entity: Column) -> Column:
    """individual or combination, by the name of a rule's predictions."""
    return F.when(entity.contains(" AND ") | entity.contains(" OR "), "combination").otherwise("individual")


def combined(names: list[str], operation: str) -> Column:
    if operation not in ("AND", "OR"):
        raise ValueError(f"unknown operation {operation!r}")
    flags = [F.col(n) == 1 for n in names]
    return reduce((lambda a, b: a & b) if operation == "AND" else (lambda a, b: a | b), flags).cast("int")


def defaults(names: list[str]) -> list[str]:
    """All pairs with AND, all with AND, then the same with OR."""
    out = []
    for op in ("AND", "OR"):
        out += [f"{a} {op} {b}" for a, b in combinations(names, 2)]
        if len(names) > 2:
            out.append(f" {op} ".join(names))
    return out


def predictions(df: DataFrame, names: list[str], expressions: list[str], keep: list[str]) -> DataFrame:
    """keep, entity, entity_type, y_pred: one row for each row of df and rule, in one narrow pass."""
    rules = [(n, "rule", F.col(n).cast("int")) for n in names] + [(e, "combination", combined(*parse(e))) for e in expressions]
    each = F.array(*[F.struct(F.lit(n).alias("entity"), F.lit(t).alias("entity_type"), c.alias("y_pred")) for n, t, c in rules])
    return df.select(*keep, F.explode(each).alias("e")).select(*keep, "e.entity", "e.entity_type", "e.y_pred")


def validate(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """name, bad: values other than 0, 1 and null."""
    if missing := [n for n in names if n not in df.columns or n == target]:
        raise ValueError(f"not usable as rules: {missing}")
    counts = df.agg(*[F.count_if(~F.col(n).isin(0, 1)).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("bad")) for n in names])).alias("r")).select("r.*")


def where_any(df: DataFrame, names: list[str], every: bool = False) -> DataFrame:
    """Rows with any (or every) rule at 1; unknown names are ignored, none known leaves df as it is."""
    known = [n for n in names if n in df.columns]
    return df.where(combined(known, "AND" if every else "OR") == 1) if known else df
