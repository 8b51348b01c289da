"""Raw text snapshots to a typed, renamed and cleaned panel of the same grain."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import (
    clean_text,
    months_between_labels,
    normal_code,
    to_date,
    to_double,
    to_integer,
    yes_flag,
)
from panelmill.schema import ENTITY, FLAG_PATTERN, PERIOD, flag_columns

FILLED = "flags_filled_from_null"


@dataclass(frozen=True)
class Field:
    """How one raw attribute is staged. `kind` is a cleaning rule of `_clean`."""

    source: str
    target: str
    kind: str
    missing: int | None = None
    allowed: tuple[str, ...] = ()


# Attributes of the raw snapshot file and what they are staged as.
HOLDINGS_FIELDS = (
    Field("ind_empleado", "employee_index", "text"),
    Field("pais_residencia", "country", "text"),
    Field("sexo", "sex", "text"),
    Field("age", "age", "int"),
    Field("fecha_alta", "join_date", "date"),
    Field("ind_nuevo", "is_new_customer", "tinyint"),
    Field("antiguedad", "seniority_months", "int", missing=-999999),
    Field("indrel", "primary_status", "tinyint"),
    Field("ult_fec_cli_1t", "last_primary_date", "date"),
    Field("indrel_1mes", "customer_type", "code", allowed=("1", "2", "3", "4", "P")),
    Field("tiprel_1mes", "relation_type", "text"),
    Field("indresi", "is_resident", "yes"),
    Field("indext", "is_foreign_born", "yes"),
    Field("conyuemp", "is_employee_spouse", "yes"),
    Field("canal_entrada", "channel", "text"),
    Field("indfall", "is_deceased", "yes"),
    Field("tipodom", "address_type", "tinyint"),
    Field("cod_prov", "province_code", "int"),
    Field("nomprov", "province_name", "text"),
    Field("ind_actividad_cliente", "is_active", "tinyint"),
    Field("renta", "income", "double"),
    Field("segmento", "segment", "text"),
)
SNAPSHOT_DATE_SOURCE = "fecha_dato"
ENTITY_SOURCE = "ncodpers"
YES = "S"


def _clean(field: Field) -> Column:
    raw = F.col(field.source)
    if field.kind == "text":
        return clean_text(raw)
    if field.kind == "date":
        return to_date(raw)
    if field.kind == "double":
        return to_double(raw)
    if field.kind == "yes":
        return yes_flag(raw, YES)
    if field.kind == "code":
        return normal_code(raw, field.allowed)
    number = to_integer(raw, field.kind)
    return number if field.missing is None else F.nullif(number, F.lit(field.missing))


def month_index(date: Column, first_month: dt.date) -> Column:
    """Calendar months from the first snapshot month."""
    return months_between_labels(F.lit(first_month), date)


def filled_flag_count(flags: Sequence[str]) -> Column:
    """NULL flags of a row.

    The higher-order function is deliberate: a projection that holds one is not fused into a single
    generated method. Staging is wide enough for that method to exceed what the JIT compiles; on its own, the
    projection is generated in many small methods and runs several times faster.
    """
    missing = F.filter(F.array(*[F.col(flag) for flag in flags]), lambda flag: flag.isNull())
    return F.size(missing).cast("tinyint")


def fill_flags(df: DataFrame, flags: Sequence[str] | None = None) -> DataFrame:
    """Count the NULL flags of each row, then read them as 0."""
    flags = list(flags) if flags is not None else flag_columns(df, FLAG_PATTERN)
    others = [name for name in df.columns if name not in flags]
    return df.select(
        *others,
        filled_flag_count(flags).alias(FILLED),
        *[F.coalesce(F.col(flag), F.lit(0)).cast("tinyint").alias(flag) for flag in flags],
    )


def stage_snapshots(
    raw: DataFrame, first_month: dt.date, fields: Sequence[Field] = HOLDINGS_FIELDS, pattern: str = FLAG_PATTERN
) -> DataFrame:
    """One projection over the raw rows: no shuffle, and columns nobody uses are never read."""
    flags = flag_columns(raw, pattern)
    columns: list[Column] = [
        F.col(SNAPSHOT_DATE_SOURCE).alias("snapshot_date"),
        month_index(F.col(SNAPSHOT_DATE_SOURCE), first_month).alias(PERIOD),
        F.col(ENTITY_SOURCE).alias(ENTITY),
    ]
    for field in fields:
        columns.append(_clean(field).alias(field.target))
        if field.target == "income":
            columns.append(_clean(field).isNull().alias("income_missing"))
    columns.append(filled_flag_count(flags).alias(FILLED))
    columns += [F.coalesce(F.col(flag), F.lit(0)).cast("tinyint").alias(flag) for flag in flags]
    return raw.select(*columns)
