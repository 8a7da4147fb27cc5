"""The registry of record formats: how each is read and written, and which columns it can be sorted or scored by."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceflow.functions import text as fn
from sluiceflow.sources import reads, records, writers


@dataclass(frozen=True)
class RecordFormat:
    """A reader, the named values derived from its rows, and a writer of such rows (rows, path, order)."""

    read: Callable[[SparkSession, str], DataFrame]
    identifiers: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    write: Callable[[DataFrame, str, Sequence[str]], None] | None = None


_formats: dict[str, RecordFormat] = {}


def register_format(name: str, record_format: RecordFormat) -> None:
    _formats[name] = record_format


def record_format(name: str) -> RecordFormat:
    if name not in _formats:
        raise KeyError(f"no record format {name!r}; known: {', '.join(sorted(_formats))}")
    return _formats[name]


def identifier(name: str, column: str) -> Column:
    known = record_format(name).identifiers
    if column not in known:
        raise KeyError(f"format {name!r} has no identifier {column!r}; known: {', '.join(sorted(known))}")
    return known[column]().alias(column)


def read(spark: SparkSession, name: str, path: str, *identifiers: str) -> DataFrame:
    """Rows of a format with the wanted identifier columns added."""
    frame = record_format(name).read(spark, path)
    return frame.select("*", *[identifier(name, i) for i in identifiers])


def writer(name: str) -> Callable[[DataFrame, str, Sequence[str]], None]:
    known = record_format(name).write
    if known is None:
        raise KeyError(f"format {name!r} has no writer")
    return known


def combine(spark: SparkSession, name: str, paths: Sequence[str], path: str, *order_by: str) -> None:
    """Merge several inputs of a format into one output, by identifiers or columns if any are given."""
    known = record_format(name)
    named = [i for i in order_by if i in known.identifiers]
    if name == "mzML":
        frames = [records.read_spectra_xml(spark, p) for p in paths]
        if order_by:
            raise ValueError("spectra are merged in the order of their ids")
    else:
        frames = [read(spark, name, p, *named) for p in paths]
    writers.merge(writer(name), path, *frames, order_by=order_by)


register_format("new_line", RecordFormat(records.read_lines, write=writers.lines(lambda: F.col("value"))))
register_format("bed", RecordFormat(records.read_bed, {
    "start_position": lambda: F.col("start"), "end_position": lambda: F.col("end"),
}, writers.lines(writers.bed_line)))
register_format("fasta", RecordFormat(records.read_fasta, write=writers.lines(writers.fasta_record)))
register_format("fastq", RecordFormat(reads.read_fastq, {
    "signature": lambda: fn.signature(F.col("seq")), "minimizer": lambda: fn.minimizer(F.col("seq")),
}, writers.lines(writers.fastq_record)))
register_format("blast", RecordFormat(records.read_alignments, {"score": lambda: F.col("score") + 0}, writers.lines(writers.alignment_paragraph, "\n\n")))
register_format("mzML", RecordFormat(records.read_spectra, {
    "id": lambda: F.regexp_extract("_id", r"scan=([0-9]+)", 1).cast("bigint"),
    "mass": lambda: fn.param(F.col("cvParam"), "base peak m/z").cast("double"),
    "tic": lambda: fn.param(F.col("cvParam"), "total ion current").cast("double"),
}, writers.write_mzml))
register_format("confidence", RecordFormat(records.read_confidence, {"q-value": lambda: F.col("qvalue")}, writers.write_scored))
register_format("percolator", RecordFormat(records.read_percolator, {"q-value": lambda: F.col("qvalue")}, writers.write_scored))
register_format("classification", RecordFormat(records.read_vectors))
register_format("knn", RecordFormat(records.read_neighbors, {"point": lambda: records.point_value(F.col("point"))}, writers.lines(writers.neighbor_record)))
register_format("pixel", RecordFormat(records.read_pixels, write=writers.lines(lambda: F.concat_ws(" ", "x", "y", "r", "g", "b"))))
register_format("pivot", RecordFormat(records.read_pivots, write=writers.write_pivots))
