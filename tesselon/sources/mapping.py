"""Canonical mapping: renames, safe casts, constants and row diagnostics, and the checks of a declared schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = {"smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}
INTEGERS = {"short": "smallint", "smallint": "smallint", "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint"}


@dataclass(frozen=True)
class Field:
    """A canonical column: its source column, or a constant where ``source`` is None."""

    name: str
    type: str
    source: str | None = None
    nullable: bool = True
    constant: object = None


def safe_cast(value: Column, source: str, target: str) -> tuple[Column, Column]:
    """(cast value, whether the cast would lose something). What would be lost is null."""
    whole = INTEGERS.get(target)
    if whole and (source in ("float", "double", "string") or source.startswith("decimal")):
        number = value.cast("double") if source != "string" else value.try_cast("double")
        low, high = RANGES[whole]
        top = number < 2.0**63 if whole == "bigint" else number <= high
        fits = (number == F.floor(number)) & (number >= low) & top
        bad = value.isNotNull() & ~F.coalesce(fits, F.lit(False))
        return F.when(fits, number.try_cast(whole)), F.coalesce(bad, F.lit(False))
    cast = value.try_cast(target)
    return cast, value.isNotNull() & cast.isNull()


def canonical(df: DataFrame, fields: list[Field], strict: bool = True) -> DataFrame:
    """The declared columns of a frame. In strict mode a value that its type can't hold, or a null where none is allowed, fails the job."""
    types, out = dict(df.dtypes), []
    if missing := [f.source for f in fields if f.source and f.source not in types]:
        raise ValueError(f"source columns missing: {', '.join(missing)}")
    for f in fields:
        if f.source is None:
            value = F.lit(f.constant).cast(f.type)
        else:
            value, lost = safe_cast(F.col(f.source), types[f.source], f.type)
            if strict:
                problem = F.concat(F.lit(f"{f.name} can't hold "), F.col(f.source).cast("string"))
                value = F.when(lost, F.raise_error(problem).cast(f.type)).otherwise(value)
        if strict and not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{f.name} is null")).cast(f.type))
        out.append(value.alias(f.name))
    return df.select(*out)


def violations(df: DataFrame, fields: list[Field]) -> DataFrame:
    """(field, nulls, lost): of every declared column, counted in one pass."""
    types = dict(df.dtypes)
    kept = [f for f in fields if f.source in types]
    one = df.agg(*(F.struct(F.count_if(F.col(f.source).isNull()).alias("nulls"), F.count_if(safe_cast(F.col(f.source), types[f.source], f.type)[1]).alias("lost")).alias(f.name) for f in kept))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("field"), F.col(f"{f.name}.nulls").alias("nulls"), F.col(f"{f.name}.lost").alias("lost")) for f in kept))).alias("v")).select("v.*")


def with_diagnostics(df: DataFrame) -> DataFrame:
    """Adds the row's place in its Parquet file: source_file and row_offset."""
    return df.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("row_offset"))
