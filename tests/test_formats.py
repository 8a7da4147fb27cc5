"""Literal files in, exact records out; small splits force records across boundaries."""

from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceflow.flow import Flow
from sluiceflow.functions import text as fn
from sluiceflow.operators import sorting
from sluiceflow.operators.neighbors import merge_lists
from sluiceflow.operators.ordered import numbered
from sluiceflow.sources import formats, logs, records, sinks, writers
from sluiceflow.sources.reads import read_fastq

READS = [
    ("lane1/first", "GATTACAGATTACA", "IIIIHHHHGGGGFF"),
    ("lane1/second longer", "TTTTGGGGCCCCAAAANNNN", "!!!!####$$$$%%%%&&&&"),
    ("lane2/third", "CAT", "~~~"),
    ("odd", "ACGTACGTNNAC", "@+@+@+@+@+@+"),
    ("plus", "ACGTACGTAC", "+@@@@@@@@@"),
]


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines(spark, put, small_splits):
    folder = put("a", "north wind\nsouth\n77 8\n \n\nwest gate\neast\n")
    df = records.read_lines(spark, folder)
    assert df.rdd.getNumPartitions() > 1
    assert sorted(values(df, "value")) == sorted(["north wind", "south", "77 8", "west gate", "east"])


def test_long_lines(spark, put, small_splits):
    folder = put("a", "a line of many words, much longer than a split\nand one more such line\nthe last of the three\n")
    assert records.read_lines(spark, folder).count() == 3


def test_tsv_header_once_per_file(spark, put):
    for i in range(4):
        folder = put(f"{i}.tsv", "id\tkind\tsize\nx1\tred\t4\nx2\tblue\t\nx3\t\t9\n")
    rows = values(records.read_tsv(spark, folder, "c0 string, c1 string, c2 string"), "c0", "c1", "c2")
    assert len(rows) == 12 and ("id", "kind", "size") not in rows


def test_bed(spark, put):
    folder = put("a.bed", "chr1\t5\t9\n\nchr2\t1\t3\tname\t+\n")
    rows = formats.read(spark, "bed", folder, "start_position", "end_position").collect()
    assert [(r.chrom, r.start_position, r.end_position, r.rest) for r in rows] == [("chr1", 5.0, 9.0, None), ("chr2", 1.0, 3.0, "name\t+")]


def test_bed_headers_and_bad_lines(spark, put):
    folder = put("a.bed", "track name=x\nbrowser position chr1\n# note\nchr1\tfive\t9\nchr2\t1\t3\nalone\n")
    rows = sorted(values(records.read_bed(spark, folder), "chrom", "start", "end", "rest"), key=str)
    assert rows == sorted([(None, None, None, "chr1\tfive\t9"), (None, None, None, "alone"), ("chr2", 1.0, 3.0, None)], key=str)


def test_scores_beyond_whole_numbers(spark, put):
    folder = put("a.csv", "species,score\nbig,3000000000\nhalf,12.5\nnone,\nbad,text\nCost,0.25\n")
    assert {s: v for s, v in values(logs.read_scores(spark, folder), "species", "score")} == {
        "big": 3e9, "half": 12.5, "none": 0.0, "bad": None, "Cost": None,
    }


def test_outlines_keep_their_sign(spark, put):
    folder = put("a.csv", 'west,1,"POLYGON ((-1.5 2.0 0,-3.0 -4.0 0,5.0 6.0 0,-1.5 2.0 0))",1\n')
    assert [[(v.x, v.y) for v in r.vertices] for r in records.read_polygons(spark, folder).collect()] == [[(-1.5, 2.0), (-3.0, -4.0), (5.0, 6.0)]]


def test_spectra_without_children(spark, put):
    inner = '<cvParam name="ms level" value="2"/>'
    folder = put("a.mzML", f'<run><spectrum id="1" index="0"/>\n<spectrum id="2" index="1">{inner}</spectrum><spectrum id="3" index="2"/><spectrum id="4" index="3"/></run>')
    assert sorted(values(records.read_spectra(spark, folder, None), "_id")) == ["1", "2", "3", "4"]
    assert values(records.read_spectra(spark, folder), "_id") == ["2"]


def test_a_dead_run_is_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    (tmp_path / "out" / "_temporary" / "0").mkdir(parents=True)
    sinks.write_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    sinks.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


def test_fasta(spark, put, small_splits):
    folder = put("a.fasta", ">p1\tempty\n>p2\tcut\nMKV\nLL>A\n>p3\n")
    rows = values(records.read_fasta(spark, folder), "header", "sequence")
    assert sorted(rows) == sorted([("p1\tempty", ""), ("p2\tcut", "MKVLL>A"), ("p3", "")])


@pytest.mark.parametrize("split", [1, 7, 33, 100, 100_000])
def test_fastq(spark, put, split):
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in READS)
    folder = put("a.fastq", text)
    put("b.fastq", text.rstrip("\n"))
    rows = values(read_fastq(spark, folder, split), "id", "seq", "qual")
    assert sorted(rows) == sorted(READS * 2)


def test_fastq_of_windows_and_of_nothing(spark, put):
    folder = put("a.fastq", "".join(f"@{i}\r\n{s}\r\n+\r\n{q}\r\n" for i, s, q in READS))
    assert sorted(values(read_fastq(spark, folder, 20), "id", "seq", "qual")) == sorted(READS)
    assert values(read_fastq(spark, put("none/empty.fastq", "") + "/none"), "id") == []
    name = "näme 名"
    assert values(read_fastq(spark, put("more/a.fastq", f"@{name}\n\n+\n\n@x\nA\n+\n~") + "/more"), "id", "seq", "qual") == [(name, "", ""), ("x", "A", "~")]


def test_signature_and_minimizer(spark):
    df = spark.createDataFrame([("CCCCCTTAAATAGC",), ("ACGNTACGAAAAAAAA",)], "seq string")
    digits = {"A": 0, "C": 1, "G": 2, "N": 3, "T": 4}
    for row in df.select("seq", fn.signature(F.col("seq")).alias("s"), fn.minimizer(F.col("seq")).alias("m")).collect():
        expected = 0
        for base in row.seq[:8]:
            expected = expected * 5 + digits[base]
        assert row.s == expected
        assert row.m == min(row.seq[i : i + 8] for i in range(len(row.seq) - 7))


ALIGNMENTS = "\n\n".join(
    f"target_name: 1\nquery_name: 1\noptimal_alignment_score: {a} suboptimal_alignment_score: {b}"
    for a, b in [(540, 9), (300, 112), (193, 48)]
)


def test_alignments_sorted_into_bins(spark, put, small_splits):
    folder = put("a.blast", ALIGNMENTS)
    df = formats.read(spark, "blast", folder).withColumn(
        "bin", sorting.bin_column(F.col("score"), [0, 300_000, 600_000, 900_000])
    )
    assert sorted(values(df, "bin", "score")) == [(1, 193048.0), (2, 300112.0), (2, 540009.0)]


def test_alignment_without_second_score(spark, put):
    folder = put("a.blast", "target_name: t\nquery_name: q\noptimal_alignment_score: 7")
    assert values(records.read_alignments(spark, folder), "target", "query", "optimal", "suboptimal", "score") == [("t", "q", 7, None, 7000.0)]


def spectrum(scan, index, level, peak, extra=""):
    return (
        f'<spectrum id="controllerType=0 controllerNumber=1 scan={scan}" index="{index}">\n<cvParam name="ms level" value="{level}"/>\n'
        f'<cvParam name="base peak m/z" value="{peak}"/>{extra}\n</spectrum>\n'
    )


MZML = (
    '<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML><mzML><run id="r"><spectrumList count="3">\n'
    + spectrum(1, 0, 2, 123) + spectrum(2, 1, 2, 4) + spectrum(3, 2, 1, 566, "<cvParam />") + spectrum(4, 3, 2, 431)
    + "</spectrumList></run></mzML><indexList count='1'><index name='spectrum'><offset idRef='x'>1</offset></index></indexList></indexedmzML>"
)


def test_spectra(spark, put, small_splits):
    folder = put("a.mzML", MZML)
    rows = formats.read(spark, "mzML", folder, "id", "mass").collect()
    assert sorted((r.id, r.mass) for r in rows) == [(1, 123.0), (2, 4.0), (4, 431.0)]
    assert records.read_spectra(spark, folder, level=None).count() == 4


def test_spectra_merge_renumbers(spark, put):
    put("a.mzML", MZML)
    folder = put("b.mzML", MZML)
    spectra = records.read_spectra(spark, folder).withColumn("file", F.lit(0))
    merged = numbered(spectra.select("_index", F.monotonically_increasing_id().alias("pos")), ["_index", "pos"], "n")
    assert sorted(r.n - 1 for r in merged.collect()) == list(range(6))


def test_vectors_round_trip(spark, put):
    first, second = [0] * 27, [255] * 3 + [7] * 10 + [1, 2, 3] + [9] * 11
    folder = put("v", b"\r\n".join([records.vector_bytes(first, 1), records.vector_bytes(second, 0)]))
    rows = sorted(values(records.read_vectors(spark, folder), "label", "features"))
    assert rows == [(0, second), (1, first)]


def test_neighbors_round_trip(spark, put):
    line = "1.0 2.0 255 123 0,0.100000 0,0.300000 1,0.500000 1"
    folder = put("a.knn", line)
    df = records.read_neighbors(spark, folder)
    row = df.collect()[0]
    assert row.point == "1.0 2.0 255 123 0" and [(n.dist, n.cls) for n in row.neighbors] == [(0.1, 0), (0.3, 1), (0.5, 1)]
    assert values(df.select(records.neighbor_line(F.col("point"), F.col("neighbors")).alias("l")), "l") == [line]


def test_neighbor_merge(spark, put):
    put("1.knn", "3 1 9 9 9,0.250000 2,0.500000 0\n7 7 1 2 3,0.125000 1")
    folder = put("2.knn", "3 1 9 9 9,0.375000 1,0.750000 2\n8 8 4 4 4,2.000000 0")
    merged = {r.point: [n.dist for n in r.neighbors] for r in merge_lists(records.read_neighbors(spark, folder), 3).collect()}
    assert merged == {"3 1 9 9 9": [0.25, 0.375, 0.5], "7 7 1 2 3": [0.125], "8 8 4 4 4": [2.0]}


def test_pivots(spark, put):
    folder = put("a.pivot", "store\nkey/of/it\n-4\t0\t6\t90")
    rows = sorted(values(records.read_pivots(spark, folder), "bin", "lo", "hi"))
    assert rows == [(1, -4, 0), (2, 0, 6), (3, 6, 90)]


def test_pixels(spark, put):
    folder = put("a.pixel", "0 1 255 3 4\n2 3 4 5 6\n")
    assert sorted(values(records.read_pixels(spark, folder), "x", "y", "r", "g", "b")) == [(0, 1, 255, 3, 4), (2, 3, 4, 5, 6)]


def test_scored_tables(spark, put):
    header = "\t".join(f"h{i}" for i in range(11))
    rows = ["\t".join(["x"] * 9 + [q, "y"]) for q in ("0.01", "0.5", "0.001")]
    folder = put("a.txt", "\n".join([header, *rows]))
    assert sorted(values(records.read_confidence(spark, folder), "qvalue")) == [0.001, 0.01, 0.5]
    assert formats.read(spark, "confidence", folder, "q-value").where("`q-value` <= 0.01").count() == 2


def test_scored_tables_keep_every_column(spark, put):
    put("a.txt", "scan\tcharge\tsequence\tq-value\n11\t2\tPEPK\t0.02\n12\t3\tAAR\tNA\n13\t1\n")
    folder = put("b.txt", "PSMId\tq\tpeptide\tq-value\n21\tx\tLLK\t0.5\n")
    rows = {r.scan: r for r in records.read_scored(spark, folder, 3).collect()}
    assert {k: (r.qvalue, r.peptide) for k, r in rows.items()} == {"11": (0.02, "PEPK"), "12": (None, "AAR"), "13": (None, None), "21": (0.5, "LLK")}
    assert rows["11"].fields == {"scan": "11", "charge": "2", "sequence": "PEPK", "q-value": "0.02"} and rows["21"].fields["q"] == "x"


def test_image(spark, put):
    planes = np.array([[(x, y, 10 * x + y) for x in range(3)] for y in range(2)], dtype="uint8")
    folder = put("a.png", records.png(planes))
    rows = sorted(values(records.read_image(spark, folder), "x", "y", "r", "g", "b"))
    assert rows == sorted((x, y, x, y, 10 * x + y) for x in range(3) for y in range(2))


def test_polygons(spark, put):
    folder = put("a.csv", 'ImageId,BuildingId,PolygonWKT_Pix,Confidence\nimg_1,0,"POLYGON ((1.5 2 0,3 4 0,5 -6 0,1.5 2 0))",1\nimg_2,-1,POLYGON EMPTY,1\n')
    rows = {r.name: [(v.x, v.y) for v in r.vertices] for r in records.read_polygons(spark, folder).collect() if r.name}
    assert rows["img_1"] == [(1.5, 2.0), (3.0, 4.0), (5.0, -6.0)]
    assert all(not v for k, v in rows.items() if k != "img_1")


def test_key_round_trip(spark):
    name = "0/123.400000-42/12-13/3-0.000000-4-hello.txt"
    df = spark.createDataFrame([(name,), ("not a key",)], "name string").withColumn("key", fn.parse_key(F.col("name")))
    good, bad = df.collect()
    assert bad.key is None
    assert good.key.asDict() == {
        "prefix": 0, "timestamp": 123.4, "nonce": 42, "bin": 12, "num_bins": 13, "file_id": 3, "execute": 0.0,
        "num_files": 4, "suffix": "hello", "ext": "txt",
    }
    assert df.where("key is not null").select(fn.format_key(F.col("key")).alias("n")).first().n == name


def test_run_log_takes_key_from_its_own_path(spark, put, tmp_path):
    put("3/123.400000-42/1-1/2-0.000000-4-x.log", '{"name": "sort", "start_time": 10.5, "duration": 500.0, "payloads": [{"key": "k", "file_id": 1}, {"key": "l", "file_id": 2}]}')
    df = logs.read_run_logs(spark, str(tmp_path))
    row = df.first()
    assert row.end_time == 11.0 and row.key.prefix == 3 and row.key.num_files == 4
    assert values(logs.children(df), "parent", "key") == [("sort", "k"), ("sort", "l")]


def test_profiles_skip_bad_rows(spark, put):
    folder = put("p.csv", "name,size,region,split,mem,duration,cost\na,5,us,1,128,2.5,0.1\nb,x,us,1,128,2.5,0.1\nc,5,us,1,128,,0.1\n")
    assert values(logs.read_profiles(spark, folder), "name") == ["a"]


def test_scores(spark, put):
    folder = put("s.csv", "species,score\nCost,2.5\nhuman,7\nyeast,\n")
    assert sorted(values(logs.read_scores(spark, folder), "species", "score", "cost"), key=str) == [
        ("Cost", None, 2.5), ("human", 7, None), ("yeast", 0, None)
    ]


def test_access_log(spark, put):
    folder = put("a.csv", 'a,b,c,d,e,f,date\n1,2,3,4,5,6,"2017-09-25 10:00:00"\n1,2,3,4,5,6,"2017-09-26"\n1,2,3,4,5,6,"not a date"\n')
    assert [str(v) for v in values(logs.read_access(spark, folder), "at")] == ["2017-09-25 10:00:00"]


def test_memory_report(spark, put):
    folder = put("m.json", '{"timestamp": 2000, "message": "REPORT Duration: 500.5 ms Billed Duration: 600 ms Memory Size: 128 MB Max Memory Used: 64 MB"}\n')
    assert values(logs.read_memory_reports(spark, folder), "start_time", "end_time", "used", "total") == [(1.4995, 2.0, 64, 128)]


def test_markers(spark, put):
    folder = put("t.log", "x\nS3 CREATED TIME: 1.5\nEXECUTION START TIME: 2.5\nNODE START TIME: 9\nEXECUTION END TIME: 3.5\n")
    assert values(logs.read_markers(spark, folder), "s3_created", "start", "end") == [(1.5, 2.5, 3.5)]


def test_incorrect(spark, put):
    folder = put("i.txt", "Incorrect results/run1/PXD0012/x.mzML Expected human Actual yeast\n")
    row = logs.read_incorrect(spark, folder).first()
    assert (row.pxd, row.run, row.file.strip(), row.expected.strip(), row.actual) == ("PXD0012", "run1", "x.mzML", "human", "yeast")


def test_config_precedence(spark):
    maps = [F.create_map(*[F.lit(v) for kv in m.items() for v in kv]) for m in ({"a": 1, "b": 1}, {"b": 2, "c": 2}, {"c": 3})]
    assert spark.range(1).select(fn.merged(*maps).alias("m")).first().m == {"a": 1, "b": 2, "c": 3}


def test_ordered_export(spark, tmp_path):
    sinks.export_ordered(spark.range(1000).selectExpr("1000 - id AS n"), str(tmp_path / "out"), "n", header=False)
    lines = [int(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().split()]
    assert lines == list(range(1, 1001))


def test_list_folders(spark, put):
    put("a/1.txt", "x")
    put("b/2.txt", "x")
    folder = put("b/3.txt", "x")
    assert values(records.list_folders(spark, folder), "folder") == ["a", "b"]


def rows_of(df):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())


ROUND_TRIPS = {
    "new_line": ("a.txt", "first line\nsecond\n"),
    "bed": ("a.bed", "chr1\t5\t9\nchr2\t1.5\t3\tname\t+\n"),
    "fasta": ("a.fasta", ">p1 x\nMKV\nLL\n>p2\n"),
    "blast": ("a.blast", "target_name: t 1\nquery_name: q\noptimal_alignment_score: 12\tsuboptimal_alignment_score: 3\n\ntarget_name: t2\nquery_name: r\noptimal_alignment_score: 7\tsuboptimal_alignment_score: 0\n"),
    "knn": ("a.knn", "3 1 9 9 9,0.250000 2,0.500000 0\n7 7 1 2 3,0.125000 1\n"),
    "pixel": ("a.pixel", "0 1 255 3 4\n2 3 4 5 6\n"),
    "pivot": ("a.pivot", "store\nkey/of/it\n-4\t0\t6\t90"),
    "percolator": ("a.tsv", "scan\ta\tb\tc\td\te\tf\tq-value\tsequence\n4\t1\t\t3\t4\t5\t6\t0.25\tPEPK\n9\t1\t2\t3\t4\t5\t6\t0.5\tLLR\n"),
}


@pytest.mark.parametrize("name", sorted(ROUND_TRIPS))
def test_formats_are_written_as_they_are_read(spark, put, tmp_path, name):
    file, content = ROUND_TRIPS[name]
    source = put(f"in/{file}", content) + "/in"
    out = str(tmp_path / "out")
    kept = lambda df: df.drop("path")
    Flow.input(spark, name, source).write(name, out)
    assert rows_of(kept(formats.read(spark, name, out))) == rows_of(kept(formats.read(spark, name, source)))


def test_reads_are_written_in_order(spark, put, tmp_path):
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in READS)
    source = put("in/a.fastq", text) + "/in"
    out = tmp_path / "out"
    formats.combine(spark, "fastq", [source, source], str(out), "id")
    assert sorted(values(read_fastq(spark, str(out)), "id", "seq", "qual")) == sorted(READS * 2)
    merged = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert [line[1:] for line in merged.split("\n")[:-1][::4]] == sorted(i for i, _, _ in READS * 2)


def test_merged_spectra_are_one_indexed_file(spark, put, tmp_path):
    def spectrum(n):
        return f'<spectrum index="7" id="scan={n}" note="é"><cvParam name="ms level" value="2"/><binary>AA{n}=</binary></spectrum>'

    one = put("in1/a.mzML", f'<mzML><run><spectrumList count="2">{spectrum(1)}{spectrum(3)}</spectrumList></run></mzML>') + "/in1"
    put("in2/b.mzML", f'<mzML><run><spectrumList count="2">{spectrum(2)}<spectrum index="9" id="scan=4"/></spectrumList></run></mzML>')
    out = tmp_path / "out"
    formats.combine(spark, "mzML", [one, one.replace("in1", "in2")], str(out))
    data = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))
    root = ElementTree.fromstring(data)
    space = "{http://psi.hupo.org/ms/mzml}"
    spectra = root.findall(f".//{space}spectrum")
    assert [(s.get("index"), s.get("id")) for s in spectra] == [(str(i), f"scan={i + 1}") for i in range(4)]
    assert root.find(f".//{space}spectrumList").get("count") == "4"
    for offset in root.findall(f".//{space}offset"):
        place = data[int(offset.text) :]
        assert place.startswith(b"<spectrum ") and f'id="{offset.get("idRef")}"'.encode() in place[:60]
    index = int(root.find(f"{space}indexListOffset").text)
    assert data[index:].startswith(b"<indexList ")
    assert spectra[2].find(f"{space}binary").text == "AA3="


def test_merged_scored_tables_keep_the_columns_of_both(spark, tmp_path):
    paths = []
    for name, extra, value in (("one", "first only", "x"), ("two", "second only", "y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.tsv").write_text(f"scan\ta\tb\tc\td\te\tf\tq-value\tsequence\t{extra}\n{name}\t1\t2\t3\t4\t5\t6\t0.25\tPEPK\t{value}\n")
        paths.append(str(tmp_path / name))
    out = str(tmp_path / "merged")
    writers.merge(writers.write_scored, out, *[records.read_percolator(spark, p) for p in paths])
    rows = {r.scan: r for r in records.read_percolator(spark, out).collect()}
    assert len(rows) == 2 and all(r.qvalue == 0.25 for r in rows.values())
    assert rows["one"].fields["first only"] == "x" and rows["two"].fields["second only"] == "y"
    assert not rows["one"].fields["second only"] and not rows["two"].fields["first only"]
