"""Reading of argument values sent as text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types and the extensions each accepts; None accepts everything.
FILE_TYPES = {
    "file": None,
    "folder": [".zip"],
    "zip_file": [".zip"],
    "csv_file": [".csv"],
    "xlsx_file": [".xlsx"],
    "ods_file": [".ods"],
    "nifti_file": [".nii", ".nii.gz"],
    "volume_or_zip_file": [".nii", ".nii.gz", ".nrrd", ".nrrd.gz", ".gipl", ".gipl.gz", ".zip"],
    "surface_file": [".vtk", ".vtp", ".stl", ".obj", ".off"],
    "surface_or_zip_file": [".vtk", ".stl", ".zip"],
    "path": None,
}
KEPT_ITEMS = 40
ITEM_CHARS = 60
SCALAR_CHARS = 120


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parts_of(text: Column) -> Column:
    """The non-empty trimmed parts of a comma list."""
    return F.filter(F.transform(F.split(text, ","), stripped), lambda part: part != "")


def as_integer(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*\z"), stripped(text).try_cast("long"))


def as_number(text: Column) -> Column:
    return stripped(text).try_cast("double")


def as_boolean(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)


def parse_list(text: Column) -> Column:
    """A JSON array or a comma list as an array of strings; null when it starts as JSON and is not."""
    bare = stripped(text)
    parsed = F.from_json(bare, "array<string>", {"mode": "PERMISSIVE"})
    good = F.schema_of_variant(F.try_parse_json(bare)).startswith("ARRAY")
    return F.when(F.startswith(bare, F.lit("[")), F.when(good, parsed)).otherwise(parts_of(bare))


def parse_vec2(text: Column, x_range: Sequence[float] | None, y_range: Sequence[float] | None) -> Column:
    """struct(x, y, error): exactly two numbers, each inside its range, whichever way round that is written."""
    parts = parts_of(F.regexp_replace(text, r"^[\[\]() ]+|[\[\]() ]+$", ""))
    x, y = as_number(F.get(parts, 0)), as_number(F.get(parts, 1))

    def outside(value: Column, bounds) -> Column:
        return F.lit(False) if bounds is None else ~value.between(min(bounds), max(bounds)) | F.isnan(value)

    error = (F.when(text.isNull() | (F.size(parts) != 2), "two numbers expected").when(x.isNull() | y.isNull(), "not numbers")
             .when(outside(x, x_range), "x outside its range").when(outside(y, y_range), "y outside its range"))
    return F.struct(F.when(error.isNull(), x).alias("x"), F.when(error.isNull(), y).alias("y"), error.alias("error"))


def parse_multichoice(text: Column, options: Sequence[str], min_selected: int | None = None) -> Column:
    """struct(selection, error): every declared option, in order, with whether it was chosen.

    An object of option to true or false, or a comma list of the chosen ones.
    """
    bare = stripped(text)
    is_object = F.startswith(bare, F.lit("{"))
    readable = F.schema_of_variant(F.try_parse_json(bare)).startswith("OBJECT")
    sent = F.when(is_object, F.from_json(bare, "map<string,string>")).otherwise(
        F.map_from_entries(F.transform(F.array_distinct(parts_of(bare)), lambda p: F.struct(p, F.lit("true")))))
    known = F.array(*[F.lit(o) for o in options])
    unknown = F.size(F.array_except(F.map_keys(sent), known)) > 0
    flags = F.transform(known, lambda o: F.struct(o.alias("option"), F.when(
        F.map_contains_key(sent, o), as_boolean(F.try_element_at(sent, o))).otherwise(False).alias("on")))
    bad_flag = F.exists(flags, lambda f: f["on"].isNull())
    chosen = F.size(F.filter(flags, lambda f: f["on"]))
    error = (F.when(text.isNull(), "a selection expected").when(is_object & ~F.coalesce(readable, F.lit(False)), "invalid JSON")
             .when(unknown, "unknown option").when(bad_flag, "not a boolean"))
    if min_selected is not None:
        error = F.coalesce(error, F.when(chosen < min_selected, "too few selected"))
    return F.struct(F.when(error.isNull(), flags).alias("selection"), error.alias("error"))


def plain_list(items: Column) -> Column:
    """At most 40 items of 60 characters, sorted."""
    return F.slice(F.array_sort(F.transform(items, lambda i: F.substring(i.cast("string"), 1, ITEM_CHARS))), 1, KEPT_ITEMS)


def plain_map(flags: Column) -> Column:
    """The names switched on, as a plain list."""
    return plain_list(F.map_keys(F.map_filter(flags, lambda k, on: F.coalesce(on, F.lit(False)))))


def plain_scalar(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, SCALAR_CHARS)


def count_flags(flags: Column) -> Column:
    """How many options of a selection are ticked, null for none."""
    return F.nullif(F.size(F.map_filter(flags, lambda k, on: F.coalesce(on, F.lit(False)))), F.lit(0))


def count_list(items: Column) -> Column:
    return F.nullif(F.size(items), F.lit(0))


def count_text(text: Column) -> Column:
    """How many items a comma list names, null when it is no list."""
    return F.when(F.contains(text, F.lit(",")), F.nullif(F.size(parts_of(text)), F.lit(0)))


def type_by_extension(extension: Column, declared: Sequence[str]) -> Column:
    """The first declared file type that accepts the extension."""
    found = F.lit(None).cast("string")
    for name in reversed(list(declared)):
        accepted = FILE_TYPES[name]
        found = F.lit(name) if accepted is None else F.when(extension.isin(accepted), name).otherwise(found)
    return found
