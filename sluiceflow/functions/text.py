"""Scalar functions on keys, reads, reports and labels, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a key name, in order, and what each may hold.
KEY_FIELDS = (
    ("prefix", "int"), ("timestamp", "double"), ("nonce", "bigint"), ("bin", "int"), ("num_bins", "int"),
    ("file_id", "int"), ("execute", "double"), ("num_files", "int"), ("suffix", "string"),
)
KEY_PATTERN = (
    r"([0-9]+)/([0-9.]+)-([0-9]+)/([0-9]+)-([0-9]+)/"
    r"([0-9]+)-([0-9.]+)-([0-9]+)-([A-Za-z0-9]+)\.([A-Za-z0-9]+)$"
)
# Digit of each base in a read signature.
BASES, DIGITS = "ACGNT", "01234"


def parse_key(name: Column) -> Column:
    """Struct of the nine key fields and the extension; null when the name has another form."""
    parts = [
        F.regexp_extract(name, KEY_PATTERN, i + 1).try_cast(kind).alias(field)
        for i, (field, kind) in enumerate(KEY_FIELDS)
    ]
    ext = F.regexp_extract(name, KEY_PATTERN, len(KEY_FIELDS) + 1).alias("ext")
    return F.when(name.rlike(KEY_PATTERN), F.struct(*parts, ext))


def format_key(key: Column) -> Column:
    """The name of a struct of key fields; a missing `execute` counts as 0."""
    return F.format_string(
        "%d/%.6f-%d/%d-%d/%d-%.6f-%d-%s.%s",
        key["prefix"], key["timestamp"], key["nonce"], key["bin"], key["num_bins"], key["file_id"],
        F.coalesce(key["execute"], F.lit(0.0)), key["num_files"], key["suffix"], key["ext"],
    )


def signature(seq: Column, length: int = 8) -> Column:
    """The first bases of a read as a base-5 number."""
    digits = F.translate(F.substring(seq, 1, length), BASES, DIGITS)
    return F.conv(digits, 5, 10).cast("bigint")


def minimizer(seq: Column, length: int = 8) -> Column:
    """The smallest run of `length` bases. The look-ahead visits every start in one pass."""
    return F.array_min(F.regexp_extract_all(seq, F.lit(f"(?=(.{{{length}}}))"), F.lit(1)))


def align_score(report: Column) -> Column:
    """1000 × optimal score, plus the suboptimal one where the report has it."""
    best = F.regexp_extract(report, r"(?m)^optimal_alignment_score:\s([0-9]+)", 1).try_cast("double")
    second = F.regexp_extract(report, r"suboptimal_alignment_score:\s([0-9]+)", 1).try_cast("double")
    return best * 1000 + F.coalesce(second, F.lit(0.0))


def elapsed_label(seconds: Column) -> Column:
    """Elapsed seconds as `01/DD HH:MM`, where the first day is 01."""
    whole = F.floor(seconds).cast("bigint")
    day = F.floor(whole / 86400) + 1
    return F.format_string("01/%02d %02d:%02d", day, F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60)


def size_label(size: Column) -> Column:
    """Bytes in the largest unit that leaves more than one of it, with two decimals."""
    steps = (("B", 0), ("KB", 1), ("MB", 2), ("GB", 3))

    def shown(unit: str, power: int) -> Column:
        return F.format_string("%.2f" + unit, F.bround(size / float(1024**power), 2))

    label = shown(*steps[0])
    for unit, power in steps[1:]:
        label = F.when(size > 1024**power, shown(unit, power)).otherwise(label)
    return label


def words(text: Column) -> Column:
    """The distinct lower-case words between single spaces."""
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda w: w != ""))


def param(params: Column, name: str) -> Column:
    """First value of a named child of a spectrum."""
    return F.element_at(F.filter(params, lambda p: p["_name"] == name), 1)["_value"]


def merged(*maps: Column) -> Column:
    """Maps merged key by key; later maps win."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)), maps)
