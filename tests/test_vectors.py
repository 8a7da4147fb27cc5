"""Vectors in records of a fixed width: no byte of a feature parts records."""

import pytest

from sluiceflow.sources.vectors import read_fixed_vectors, write_fixed_vectors

BREAKS = int.from_bytes(b"\r\n\r\n \r\n1", "little")
VECTORS = [([BREAKS, -1, 2**63 - 1], 3), ([0, -(2**63), 0x0A0D], 0), ([0x0D, 0x0A, 0x20], 107), ([0x0A0D, 0x0A0D, 0x0A0D], 999)]


def found(df):
    return sorted((r.features, r.label) for r in df.collect())


@pytest.mark.parametrize("split", [1, 60, 100, 100_000])
def test_any_bytes_survive(spark, tmp_path, split):
    table = spark.createDataFrame(VECTORS * 5, "features array<bigint>, label int")
    path = str(tmp_path / "v")
    write_fixed_vectors(table, path, 3, 3)
    assert found(read_fixed_vectors(spark, path, 3, 3, split)) == sorted(VECTORS * 5)


def test_last_line_end_may_lack(spark, put):
    record = (5).to_bytes(8, "little") + b" 2"
    folder = put("a", record + b"\r\n" + record)
    assert found(read_fixed_vectors(spark, folder, 1)) == [([5], 2), ([5], 2)]


def test_no_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    write_fixed_vectors(spark.createDataFrame([], "features array<bigint>, label int"), path, 4)
    assert found(read_fixed_vectors(spark, path, 4)) == []


@pytest.mark.parametrize("row", [([1], 1), ([1, None], 1), (None, 1), ([1, 2], None), ([1, 2], -1), ([1, 2], 10)])
def test_what_does_not_fit_is_not_written(spark, tmp_path, row):
    with pytest.raises(Exception, match="a vector to write"):
        write_fixed_vectors(spark.createDataFrame([row], "features array<bigint>, label int"), str(tmp_path / "v"), 2)


def test_other_widths_are_refused(spark, put):
    folder = put("a", b"12345678 1\r\n")
    with pytest.raises(Exception, match="no whole records"):
        read_fixed_vectors(spark, folder, 2).collect()
    folder = put("a", b"12345678x1\r\n")
    with pytest.raises(Exception, match="other marks"):
        read_fixed_vectors(spark, folder, 1).collect()
