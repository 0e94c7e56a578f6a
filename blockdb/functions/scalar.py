"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_bucket(v: Column) -> Column:
    """Bit length: 0 for 0, 1 for 1, 2 for 2 and 3, ... at most 63."""
    return F.when(v <= 0, F.lit(0)).otherwise(F.least(F.length(F.bin(v)), F.lit(63)))


def us_bucket(ns: Column) -> Column:
    """floor(log2) of microseconds, at least 0 and at most 31."""
    return F.least(F.length(F.bin(F.greatest(F.floor(ns / 1000), F.lit(1)))) - 1, F.lit(31))


def address(segment: Column, offset: Column) -> Column:
    return F.call_function("shiftleft", segment, F.lit(16)) + offset


def aligned_range(offset: Column, length: Column, capacity: Column, unit: int = 4096) -> Column:
    """A range that is not empty, is aligned, and ends within the capacity without overflow."""
    end = F.try_add(offset, length)
    return F.coalesce((length > 0) & (offset >= 0) & (offset % unit == 0) & (length % unit == 0) & (end <= capacity), F.lit(False))


def positive_difference(a: Column, b: Column) -> Column:
    return F.greatest(b - a, F.lit(0))


def counter(json: Column, path: str) -> Column:
    """An integer counter at a JSON path; absent or not an integer is an error, never 0."""
    text = F.get_json_object(json, path)
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"no integer at {path}: "), F.coalesce(text, F.lit("absent")))))


def hex_id(text: Column, size: int = 32) -> Column:
    """Lower-case hex id; null unless it has `size` digits and is not zero."""
    low = F.lower(text)
    return F.when(low.rlike(f"^[0-9a-f]{{{size}}}$") & ~low.rlike("^0+$"), low)


def cpu_set(text: Column) -> Column:
    """`2-5,8` as an array of numbers."""
    return F.flatten(F.transform(F.split(text, ","), lambda r: F.sequence(F.substring_index(r, "-", 1).cast("int"), F.substring_index(r, "-", -1).cast("int"))))


def segment_number(name: Column) -> Column:
    """The number that a segment's name of 20 digits says; null for other names and for zero."""
    return F.when(name.rlike("^[0-9]{20}$") & ~name.rlike("^0+$"), name.try_cast("long"))


def transferred(text: Column, what: str) -> Column:
    """A byte counter of a transfer's closing lines (`sent 1,234 bytes  received 56 bytes`): sent, received or total size is."""
    return F.replace(F.regexp_extract(text, what + " ([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("long")


def placeholders(text: Column) -> Column:
    """Names in `<...>` that are still in a text, each once, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("<([a-z_]+)>"), F.lit(1))))
