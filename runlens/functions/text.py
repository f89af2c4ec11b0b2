"""Text rules: redaction, names and extensions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address, a path, a data file, an identifier or a measurement.
# Unicode letters count as word characters, as they do in the patterns' own language.
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PATH = r"""(?U)(?<![^\s'"()\[\]{}<>,;])(?!\d+/\d+[:.,;]?(?![^\s'"()\[\]{}<>,;]))[^\s'"()\[\]{}<>,;]*[/\\][^\s'"()\[\]{}<>,;]*"""
FILE = (r"(?Ui)(?<![\w.+-])[\w.+-]+\.(?:nii|gz|nrrd|nhdr|mha|mhd|dcm|dicom|vtk|vtp|stl|obj|ply|off|"
        r"json|csv|tsv|xlsx|xls|txt|pkl|pickle|pth|pt|ckpt|npy|npz|zip|tar|tgz|"
        r"png|jpe?g|tiff?|bmp|h5|hdf5|mrk|fcsv|mrml|seg|xml|yaml|yml|log)\b")
ADDRESS = r"(?U)\b\d{1,3}(?:\.\d{1,3}){3}\b"
UNIT = r"(?:ms|s|min|h|mm|cm|m|[KMGT]i?B|B|px|vox|x)"
IDENTIFIER = (r"(?U)\b(?!\d+" + UNIT + r"(?!-*[A-Za-z0-9_]))"
              r"(?=[A-Za-z0-9_-]*[A-Za-z])(?=[A-Za-z0-9_-]*\d[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{3,}\b")
MAX_REDACTED = 300
HEAD, TAIL = 117, 180
DOUBLE_EXTENSIONS = [".nii.gz", ".nrrd.gz", ".gipl.gz", ".tar.gz"]
DOUBLES = r"\.(?:nii|nrrd|gipl|tar)\.gz"
MAX_STEM = 64


def scrub_text(text: Column) -> Column:
    """The text on one line with every name in it replaced by its kind, cut in the middle."""
    value = F.translate(F.coalesce(text, F.lit("")), "\r\n", "  ")
    # A pattern is only tried on texts that have what every match of it contains.
    for needs, pattern, kind in ((r"@", EMAIL, "<email>"), (r"[/\\]", PATH, "<path>"), (r"\.", FILE, "<file>"),
                                 (r"(?U)\d\.\d", ADDRESS, "<address>"), (r"(?U)\d", IDENTIFIER, "<id>")):
        value = _once(value, _replacing(needs, pattern, kind))
    value = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    return _once(value, lambda v: F.when(F.char_length(v) <= MAX_REDACTED, v).otherwise(F.concat(
        F.rtrim(F.substring(v, 1, HEAD)), F.lit(" … "), F.ltrim(F.right(v, F.lit(TAIL))))))


def _replacing(needs: str, pattern: str, kind: str):
    return lambda v: F.when(v.rlike(needs), F.regexp_replace(v, pattern, kind)).otherwise(v)


def _once(value: Column, use) -> Column:
    """`use(value)` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def canonical_name(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def compound_extension(name: Column) -> Column:
    """The suffix in lower case, `.nii.gz` and its like counting as one; empty when there is none."""
    base = F.lower(base_name(name))
    double = F.regexp_extract(base, f"({DOUBLES})$", 1)
    single = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    return F.when(double != "", double).otherwise(single)


def stem(name: Column) -> Column:
    """The base name without its extension, compound ones included."""
    base = base_name(name)
    return F.substring(base, F.lit(1), F.char_length(base) - F.char_length(compound_extension(name)))


def safe_stem(filename: Column, extension: Column) -> Column:
    """An upload's name made safe to write: only plain characters, no dot runs, at most 64."""
    name = base_name(filename)
    ends = (extension != "") & F.endswith(F.lower(name), F.lower(extension))
    bare = F.when(ends, F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension))).otherwise(name)
    cleaned = F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9_.-]+", "_"), r"\.{2,}", ".")
    return F.substring(F.regexp_replace(cleaned, r"^[._]+|[._]+$", ""), 1, MAX_STEM)
