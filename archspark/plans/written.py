"""Text made from templates, by Spark and by SQL alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Short rows dealt to tasks by their keys, before each becomes a text: a table of a few MB is one or two splits however many rows it has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _parts(template: str) -> list[str]:
    return re.split(r"\{\{(\w+)\}\}", template)


def text(template: str, columns: dict[str, str]) -> Column:
    """The template; ``{{x}}`` is the column that columns names for x."""
    return F.concat(*[F.col(columns[x]).cast("string") if j % 2 else F.lit(x) for j, x in enumerate(_parts(template))])


def text_sql(template: str, columns: dict[str, str]) -> str:
    parts = _parts(template)
    return " || ".join(f"cast({columns[x]} as varchar)" if j % 2 else quoted(x) for j, x in enumerate(parts) if x or len(parts) == 1)


def choice(values: list, key: str) -> Column:
    """values[key modulo their number]; None is null. key: an expression with ``//`` for whole division."""
    column = None
    for i, v in enumerate(values):
        same = F.expr(f"{key} % {len(values)}".replace("//", "div")) == i
        column = F.when(same, F.lit(v)) if column is None else column.when(same, F.lit(v))
    return column


def choice_sql(values: list, key: str) -> str:
    shown = ["null" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() for v in values]
    return f"case {key} % {len(values)} {' '.join(f'when {i} then {v}' for i, v in enumerate(shown))} end"
