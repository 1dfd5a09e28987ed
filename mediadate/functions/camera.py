"""Coordinates and camera fields of a picture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_degrees(dms: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as signed degrees; null without all three and a reference."""
    degrees = (
        F.try_element_at(dms, F.lit(1))
        + F.try_element_at(dms, F.lit(2)) / F.lit(60.0)
        + F.try_element_at(dms, F.lit(3)) / F.lit(3600.0)
    )
    signed = F.when(ref.isin("S", "W"), -degrees).otherwise(degrees)
    return F.when((F.size(dms) == 3) & (ref != ""), signed)


def one_decimal(number: Column) -> Column:
    """One decimal, rounded half to even on the exact binary value."""
    return F.replace(F.format_number(number, 1), F.lit(","), F.lit(""))


def clean_text(text: Column) -> Column:
    """Text without surrounding blanks; an empty text is no text."""
    return F.when(text != "", F.regexp_replace(text, r"^\s+|\s+\z", ""))


def camera_fields(make: Column, model: Column, f_number: Column, iso: Column, focal_length: Column) -> list[Column]:
    """The five camera columns of the catalog from numeric tags."""
    return [
        clean_text(make).alias("camera_make"),
        clean_text(model).alias("camera_model"),
        F.concat(F.lit("f/"), one_decimal(f_number.cast("double"))).alias("aperture"),
        iso.cast("string").alias("iso_speed"),
        F.concat(one_decimal(focal_length.cast("double")), F.lit("mm")).alias("focal_length_mm"),
    ]
