"""Readers of delimited record files. All are splittable and keep whole records."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceflow.functions.text import align_score


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that hold more than white space."""
    return spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"\S"))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, quote="", enforceSchema=True)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, rest): intervals; further columns stay in `rest`.

    Track, browser and comment lines are headers and left out. A line without
    two numbers has null bounds and is kept whole in `rest`.
    """
    parts = F.split("value", "\t", 4)
    start, end = (F.get(parts, k).try_cast("double") for k in (1, 2))
    good = start.isNotNull() & end.isNotNull()
    return read_lines(spark, path).where(~F.col("value").rlike(r"^(track|browser)\b|^#")).select(
        F.when(good, parts[0]).alias("chrom"), F.when(good, start).alias("start"), F.when(good, end).alias("end"),
        F.when(good, F.get(parts, 3)).otherwise(F.col("value")).alias("rest"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): records that begin with `>` at the start of a line."""
    record = F.regexp_replace("value", "^>", "")
    cut = F.split(record, "\n", 2)
    sequence = F.regexp_replace(F.coalesce(F.get(cut, 1), F.lit("")), r"[\r\n]", "")
    return (
        spark.read.text(path, lineSep="\n>").where(F.col("value").rlike(r"\S"))
        .select(F.rtrim(cut[0]).alias("header"), sequence.alias("sequence"))
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(target, query, optimal, suboptimal, score): paragraphs of an alignment report."""

    def number(name: str) -> Column:
        return F.regexp_extract("value", name + r":\s([0-9]+)", 1).try_cast("bigint")

    return spark.read.text(path, lineSep="\n\n").where(F.col("value").rlike(r"\S")).select(
        F.regexp_extract("value", r"target_name: ([^\n]*)", 1).alias("target"),
        F.regexp_extract("value", r"query_name: ([^\n]*)", 1).alias("query"),
        number(r"(?m)^optimal_alignment_score").alias("optimal"),
        number("suboptimal_alignment_score").alias("suboptimal"),
        align_score(F.col("value")).alias("score"),
    )


def read_neighbors(spark: SparkSession, path: str) -> DataFrame:
    """(point, neighbors): `point,dist cls,dist cls…` lines."""
    parts = F.split("value", ",")

    def pair(text: Column) -> Column:
        cut = F.split(text, " ")
        return F.struct(cut[0].cast("double").alias("dist"), cut[1].cast("int").alias("cls"))

    return read_lines(spark, path).select(
        parts[0].alias("point"), F.transform(F.slice(parts, 2, F.size(parts)), pair).alias("neighbors")
    )


def neighbor_line(point: Column, neighbors: Column) -> Column:
    """The line `read_neighbors` reads."""
    pairs = F.transform(neighbors, lambda n: F.format_string("%.6f %d", n["dist"], n["cls"]))
    return F.concat_ws(",", point, pairs)


def point_value(point: Column) -> Column:
    """The sort value of a point `x y`: the number x.y."""
    return F.replace(point, F.lit(" "), F.lit(".")).cast("double")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="x int, y int, r int, g int, b int", sep=" ")


def read_scored(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(path, qvalue, scan, peptide, fields): a scored table with a header.

    The q-value is in one 0-based column, scan and peptide are found by their
    names in the header of each file, and `fields` has every column by name. A
    short row has null values for what it lacks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\t").alias("cells"))
    # A file's header is its one line whose q-value cell is a name; a missing value is not a name.
    cell = F.trim(F.get("cells", column))
    is_header = F.coalesce(cell.rlike("[A-Za-z]") & cell.try_cast("double").isNull() & ~F.lower(cell).isin("na", "n/a", "null", "none"), F.lit(False))
    heads = lines.where(is_header).groupBy("path").agg(F.first("cells").alias("names"))
    rows = lines.where(~is_header & (F.concat_ws("", "cells") != "")).join(heads, "path", "left")
    names = F.coalesce("names", F.transform("cells", lambda c, i: F.concat(F.lit("c"), i)))
    padded = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.get("cells", i))
    named = F.map_from_arrays(names, padded)
    return rows.select(
        "path", F.get("cells", column).try_cast("double").alias("qvalue"),
        F.coalesce(F.try_element_at(named, F.lit("scan")), F.try_element_at(named, F.lit("PSMId"))).alias("scan"),
        F.coalesce(F.try_element_at(named, F.lit("sequence")), F.try_element_at(named, F.lit("peptide"))).alias("peptide"), named.alias("fields"),
    )


def read_confidence(spark: SparkSession, path: str) -> DataFrame:
    return read_scored(spark, path, 9)


def read_percolator(spark: SparkSession, path: str) -> DataFrame:
    return read_scored(spark, path, 7)


def read_pivots(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, key, bin, lo, hi): the ranges of each boundary file, whole numbers, half open, bins from 1."""
    lines = F.split("value", "\n")
    bounds = F.transform(F.split(F.rtrim(lines[2]), "\t"), lambda b: b.cast("double").cast("bigint"))
    pairs = F.zip_with(F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds)), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    files = spark.read.text(path, wholetext=True).select(lines[0].alias("bucket"), lines[1].alias("key"), pairs.alias("pairs"))
    return files.select("bucket", "key", F.posexplode("pairs")).select(
        "bucket", "key", (F.col("pos") + 1).alias("bin"), F.col("col.lo").alias("lo"), F.col("col.hi").alias("hi")
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, vertices): outlines from `name,id,"POLYGON ((x y z,…))"`; EMPTY has no vertices.

    The closing vertex repeats the first one and is dropped.
    """
    line = F.col("value")
    number = r"(-?[0-9.]+) (-?[0-9.]+) -?[0-9.]+"
    xs, ys = (F.transform(F.regexp_extract_all(line, F.lit(number), F.lit(i)), lambda v: v.cast("double")) for i in (1, 2))
    ring = F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    none = F.slice(ring, 1, 0)
    outline = F.when(line.contains("EMPTY"), none).otherwise(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    return read_lines(spark, path).where(line.contains("POLYGON") | line.contains("EMPTY")).select(
        F.regexp_extract("value", r"^([A-Za-z0-9_]+),", 1).alias("name"),
        F.regexp_extract("value", r"^[A-Za-z0-9_]+,(-?[0-9]+),", 1).try_cast("int").alias("id"),
        outline.alias("vertices"),
    )


SPECTRUM = "_id string, _index bigint, cvParam array<struct<_name string, _value string>>"


def read_spectra_xml(spark: SparkSession, path: str) -> DataFrame:
    """(xml): the spectrum elements of an mzML file as they are.

    The text is cut at the closing tags, so one large file is shared by many
    tasks; each piece then holds one spectrum's XML.
    """
    # Elements without children have no closing tag, so a piece may hold several of them before its own.
    empty = F.regexp_extract_all("value", F.lit(r"<spectrum\s[^<>]*/>"), F.lit(0))
    element = F.regexp_extract("value", r"(?s).*(<spectrum\s[^<>]*[^<>/]>.*)", 1)
    whole = F.when(element != "", F.array(F.concat(element, F.lit("</spectrum>")))).otherwise(F.array().cast("array<string>"))
    return spark.read.text(path, lineSep="</spectrum>").select(F.explode(F.concat(empty, whole)).alias("xml"))


def read_spectra(spark: SparkSession, path: str, level: str | None = "2") -> DataFrame:
    """(_id, _index, cvParam): spectra of an mzML file, by default those with MS level 2."""
    return parsed_spectra(read_spectra_xml(spark, path), level)


def parsed_spectra(pieces: DataFrame, level: str | None = "2") -> DataFrame:
    """(_id, _index, cvParam) of the spectra in `xml`, from a file or a stream."""
    if level is not None:
        # A cheap text test before any XML is parsed; the exact test follows.
        pieces = pieces.where(F.col("xml").contains("ms level"))
    parsed = pieces.select(F.from_xml("xml", SPECTRUM, {"rowTag": "spectrum"}).alias("s")).select("s.*")
    if level is None:
        return parsed
    return parsed.where(F.exists("cvParam", lambda p: (p["_name"] == "ms level") & (p["_value"] == level)))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(features, label): int64 features as raw bytes, a space and the class, records parted by CR LF."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [raw.rsplit(b" ", 1) for raw in batch["raw"]]
            yield pd.DataFrame({
                "features": [np.frombuffer(head, dtype="<i8") for head, _ in cut],
                "label": np.array([int(tail) for _, tail in cut], dtype="int32"),
            })

    raw = spark.read.text(path, lineSep="\r\n").where(F.length("value") > 0).select(F.col("value").cast("binary").alias("raw"))
    return raw.mapInPandas(decode, "features array<bigint>, label int")


def vector_bytes(features: list[int], label: int) -> bytes:
    """One record as `read_vectors` reads it."""
    return np.asarray(features, dtype="<i8").tobytes() + f" {label}".encode()


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, r, g, b): every pixel of every image."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch.itertuples():
                planes = np.frombuffer(image.data, dtype=np.uint8).reshape(image.height, image.width, image.channels)
                if image.channels == 1:
                    planes = np.repeat(planes, 3, axis=2)
                # A stripe of rows at a time keeps the frames small.
                stripe = max(1, 500_000 // max(1, image.width))
                for top in range(0, image.height, stripe):
                    rows = planes[top : top + stripe].astype("int32")
                    y, x = np.mgrid[top : top + len(rows), 0 : image.width].astype("int32")
                    yield pd.DataFrame({
                        "path": image.origin, "x": x.ravel(), "y": y.ravel(),
                        "r": rows[:, :, 2].ravel(), "g": rows[:, :, 1].ravel(), "b": rows[:, :, 0].ravel(),
                    })

    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    fields = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return fields.withColumnRenamed("nChannels", "channels").mapInPandas(explode, "path string, x int, y int, r int, g int, b int")


def png(planes: np.ndarray) -> bytes:
    """An image file of (height, width, 3) bytes."""
    height, width, _ = planes.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    rows = np.hstack([np.zeros((height, 1), dtype=np.uint8), planes.reshape(height, width * 3)])
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def list_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder): distinct first-level folders below a path, sorted."""
    inner = F.regexp_extract("path", r"\Q" + path.rstrip("/").replace("file:", "") + r"\E/([^/]+)/", 1)
    return list_objects(spark, path).select(inner.alias("folder")).where("folder <> ''").distinct().orderBy("folder")
