"""Writers and merges of the record formats.

A format is written as a folder of part files, in many tasks. With an order, the
parts' names follow it, so that one after the other they are the merged file.
What a format needs at its ends (a header, a count, an index of offsets) is made
of rows like the records and sorted around them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import Ordered
from sluiceflow.operators.verbs import combine
from sluiceflow.sources import records


def _text(df: DataFrame, path: str, line: Column, order_by: Sequence[str], separator: str = "\n") -> None:
    laid = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    laid.select(line.alias("value")).write.option("lineSep", separator).text(path)


def lines(line: Callable[[], Column], separator: str = "\n") -> Callable[[DataFrame, str, Sequence[str]], None]:
    """A writer of one text record per row."""

    def write(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
        _text(df, path, line(), order_by, separator)

    return write


def _number(value: str) -> Column:
    column = F.col(value)
    return F.when(column == F.floor(column), column.cast("bigint").cast("string")).otherwise(column.cast("string"))


def bed_line() -> Column:
    return F.concat_ws("\t", "chrom", _number("start"), _number("end"), "rest")


def fasta_record() -> Column:
    return F.concat(F.lit(">"), "header", F.when(F.col("sequence") != "", F.concat(F.lit("\n"), "sequence")).otherwise(F.lit("")))


def fastq_record() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual")


def alignment_paragraph() -> Column:
    return F.concat(
        F.lit("target_name: "), "target", F.lit("\nquery_name: "), "query", F.lit("\noptimal_alignment_score: "), "optimal",
        F.lit("\tsuboptimal_alignment_score: "), "suboptimal",
    )


def neighbor_record() -> Column:
    return records.neighbor_line(F.col("point"), F.col("neighbors"))


def write_pivots(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """A file per (bucket, key) with its boundaries; a group has one row per range."""
    ranges = df.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(F.struct("bin", "lo", "hi"))).alias("r"))
    bounds = F.concat(F.transform("r", lambda r: r.lo), F.array(F.element_at("r", -1).hi))
    content = F.concat_ws("\n", "bucket", "key", F.concat_ws("\t", bounds.cast("array<string>")))
    ranges.select(content.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def write_scored(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """Tab-separated tables with every column that any row has in `fields`, a header in each part; a row without it has an empty cell."""
    # As many as there are headers, in the order of the rows that have them first.
    headers = df.select(F.map_keys("fields").alias("header"), F.monotonically_increasing_id().alias("at")).groupBy("header").agg(F.min("at").alias("at"))
    found = sorted((r for r in headers.collect() if r["header"]), key=lambda r: r["at"])
    names = list(dict.fromkeys(name for r in found for name in r["header"]))
    laid = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    cells = [F.try_element_at("fields", F.lit(n)).alias(n) for n in names]
    laid.select(*cells).write.option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">\n<mzML version="1.1.0">\n<run id="run">\n'
    '<spectrumList count="%d">'
)
MIDDLE = '</spectrumList>\n</run>\n</mzML>\n<indexList count="1">\n<index name="spectrum">'
TAIL = "</index>\n</indexList>\n<indexListOffset>%d</indexListOffset>\n</indexedmzML>"


def write_mzml(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """Parts that one after the other are an indexed mzML file: count, spectra numbered anew, and their byte offsets.

    `df` has the spectra's XML in `xml`, as `read_spectra_xml` gives it. Without an order they go by their id.
    """
    clean = F.regexp_replace("xml", r'^(<spectrum\s[^>]*?)\s*\bindex="[0-9]*"', "$1")
    keyed = df.select(*dict.fromkeys([*order_by, "xml"])).withColumn("xml", clean)
    keyed = keyed.withColumn("__id", F.regexp_extract("xml", r'\bid="([^"]*)"', 1))
    order = [*order_by, "__id", "xml"]
    placed = Ordered(keyed, list(dict.fromkeys(order))).extend(row_number="__nr")
    # The number is part of the bytes, so offsets are summed after numbering.
    numbered = placed.select(
        (F.col("__nr") - 1).alias("nr"), "__id",
        F.concat(F.lit('<spectrum index="'), F.col("__nr") - 1, F.lit('"'), F.substring(F.col("xml"), F.lit(len("<spectrum") + 1), F.length("xml"))).alias("line"),
    ).withColumn("size", F.octet_length("line") + 1)
    summed = Ordered(numbered, ["nr"]).extend(running={"end": F.col("size")}).select("nr", "__id", "line", (F.col("end") - F.col("size")).alias("at"), "end")
    count, total = summed.agg(F.count("*"), F.max("end")).first()
    head = HEAD % count
    begin = len(head.encode()) + 1
    index_at = begin + (total or 0) + len("</spectrumList>\n</run>\n</mzML>\n")
    section = lambda k, nr, text: F.struct(F.lit(k).alias("section"), nr.cast("bigint").alias("nr"), text.alias("line"))
    offset = F.concat(F.lit('<offset idRef="'), "__id", F.lit('">'), F.col("at") + begin, F.lit("</offset>"))
    body = summed.select(F.inline(F.array(section(1, F.col("nr"), F.col("line")), section(3, F.col("nr"), offset))))
    zero = F.lit(0)
    ends = df.sparkSession.range(1).select(F.inline(F.array(
        section(0, zero, F.lit(head)), section(2, zero, F.lit(MIDDLE)), section(4, zero, F.lit(TAIL % index_at)),
    )))
    _text(body.unionByName(ends), path, F.col("line"), ["section", "nr"])


def merge(write: Callable[[DataFrame, str, Sequence[str]], None], path: str, *frames: DataFrame, order_by: Sequence[str] = ()) -> None:
    """One output of several inputs of a format, in order if one is given; headers, counts and numbers are made anew."""
    write(combine(*frames), path, order_by)
