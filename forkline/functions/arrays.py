"""Column helpers for sets held in arrays, and for the text forms of part lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_items(text: Column) -> Column:
    """Items of a comma-joined list; 0 for null or the empty string."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, ",")))


def part_numbers(text: Column) -> Column:
    """`E007,E012` -> [7, 12]; null or the empty string -> []."""
    blank = F.coalesce(text, F.lit("")) == ""
    numbers = F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.trim(x), "^E", "").cast("int"))
    return F.when(blank, F.array().cast("array<int>")).otherwise(numbers)


def part_labels(numbers: Column) -> Column:
    """[7, 12] -> `E007,E012` in numeric order."""
    return F.array_join(F.transform(F.array_sort(numbers), lambda x: F.concat(F.lit("E"), F.lpad(x.cast("string"), 3, "0"))), ",")


def intersect_all(sets: Column) -> Column:
    """What all arrays of an array have in common; [] for none."""
    first = F.try_element_at(sets, F.lit(1))
    rest = F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0)))
    return F.when(F.size(sets) > 0, F.aggregate(rest, F.array_distinct(first), F.array_intersect)).otherwise(F.array().cast("array<int>"))


def union_all(sets: Column) -> Column:
    return F.array_distinct(F.flatten(sets))


def is_proper_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def proximity(reference: Column, others: Column) -> Column:
    """Least distance between two lists of numbers; infinity if one is empty."""
    near = F.array_min(F.flatten(F.transform(reference, lambda r: F.transform(others, lambda d: F.abs(r - d)))))
    return F.coalesce(near.cast("double"), F.lit(float("inf")))


def canonical(text: Column) -> Column:
    """A comma-joined list, trimmed, without repeats, in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))), ",")


def strip_version(text: Column) -> Column:
    """`ENSG01.14` -> `ENSG01`."""
    return F.regexp_replace(text, r"\.[0-9]+$", "")
