"""Operators against brute force, with hot groups and with the large-table paths forced."""

import bisect
import itertools
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluiceflow import Flow, session
from sluiceflow.operators import curves, grids, neighbors, polygons, reports, sorting, verbs
from sluiceflow.operators.panels import best_panel
from sluiceflow.operators.ordered import PIECE, Ordered, numbered
from sluiceflow.operators.overlap import top_overlaps
from sluiceflow.plans.composites import count_words

RANDOM = random.Random(7)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows have one key, and a third one value."""
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", 5 if i % 3 == 1 else RANDOM.randrange(1000)) for i in range(6000)]
    return spark.createDataFrame(rows, "id bigint, key string, v bigint").repartition(8).cache()


def test_ordered_matches_brute_force(skewed):
    out = Ordered(skewed, ["v", "id"], ["key"]).extend(
        row_number="n", running={"sum": F.col("v")}, lag={"before": F.col("id")}, lead={"after": F.col("id")},
        whole={"total": F.lit(1)},
    ).collect()
    groups = {}
    for row in skewed.collect():
        groups.setdefault(row.key, []).append((row.v, row.id))
    found = {(r.key, r.id): r for r in out}
    assert len(found) == len(out) == 6000
    for key, members in groups.items():
        members.sort()
        total = 0
        for i, (v, id_) in enumerate(members):
            total += v
            row = found[key, id_]
            assert (row.n, row["sum"], row.total) == (i + 1, total, len(members))
            assert row.before == (members[i - 1][1] if i else None)
            assert row.after == (members[i + 1][1] if i + 1 < len(members) else None)


def test_hot_group_is_spread_over_partitions(skewed):
    pieces = Ordered(skewed, ["v", "id"], ["key"]).rows.where("key = 'hot'").groupBy(PIECE).count().collect()
    assert len(pieces) >= 4
    assert max(r["count"] for r in pieces) < 2000


def test_ordered_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "key string, v int")
    rows = {(r.key, r.v): r.n for r in numbered(df, ["v"], "n", ["key"]).collect()}
    assert rows == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}


def test_ordered_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, v int")
    assert Ordered(empty, ["v"]).extend(row_number="n", running={"s": F.col("v")}).count() == 0


def test_concurrency_of_hot_times(spark):
    tasks = [(RANDOM.choice([0, 0, RANDOM.randrange(50)]), RANDOM.randrange(1, 30)) for _ in range(500)]
    df = spark.createDataFrame([(s, s + d) for s, d in tasks], "start_us bigint, end_us bigint")
    for row in curves.concurrency(df).collect():
        assert row.active == sum(s <= row.t < s + d for s, d in tasks)


def test_quartiles_match_numpy(spark, skewed):
    values = {}
    for row in skewed.collect():
        values.setdefault(row.key, []).append(row.v)
    for row in curves.quartiles(skewed, F.col("v").cast("double"), ["key"]).collect():
        expected = np.quantile(values[row.key], [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose([row.low, row.q1, row.q2, row.q3, row.high], expected)


def brute_neighbours(test, train, k, skip_same):
    out = {}
    for i, a in test:
        far = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in train if not (skip_same and i == j))
        out[i] = [j for _, j in far[:k]]
    return out


@pytest.mark.parametrize("skip_same", [True, False])
@pytest.mark.parametrize("pivots,block", [(1, 50), (9, 40), (30, 1000)])
def test_neighbours_by_cells(spark, pivots, block, skip_same):
    rng = np.random.default_rng(3)
    crowd = rng.normal(0, 0.01, (150, 4))  # a third of all vectors in one small spot
    spread = rng.normal(0, 3, (250, 4))
    copies = np.repeat(rng.normal(0, 1, (1, 4)), 50, axis=0)
    vectors = np.vstack([crowd, spread, copies])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    found = {}
    for row in neighbors.nearest(df, df, 5, skip_same=skip_same, limit=0, pivots=pivots, block=block).collect():
        found.setdefault(row.test_id, {})[row["rank"]] = row.train_id
    found = {i: [ranks[r] for r in sorted(ranks)] for i, ranks in found.items()}
    pairs = list(enumerate(vectors))
    assert found == brute_neighbours(pairs, pairs, 5, skip_same)


def test_neighbours_fewer_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id bigint, vec array<double>")
    for limit in (0, 100):
        rows = neighbors.nearest(df, df, 5, skip_same=True, limit=limit).collect()
        assert sorted((r.test_id, r.train_id) for r in rows) == [(1, 2), (2, 1)]


def test_vote_ties_and_weights(spark):
    rows = [(1, 1, 0.1, 0), (1, 2, 0.2, 1), (1, 3, 0.3, 1), (2, 1, 0.5, 0), (2, 2, 0.5, 1), (3, 1, 0.1, 1), (3, 2, 0.2, 0), (3, 3, 0.2, 0), (3, 4, 0.9, 2)]
    df = spark.createDataFrame(rows, "test_id bigint, rank int, distance double, cls int")
    # 1: class 0 has 1, class 1 has 0.5. 2: the second weighs 0. 3: class 0 has 2 × 0.875.
    assert {r.test_id: r.cls for r in neighbors.vote(df).collect()} == {1: 0, 2: 0, 3: 0}
    tie = spark.createDataFrame([(1, 1, 0.5, 0), (1, 2, 0.5, 1), (1, 3, 1.5, 1), (1, 4, 1.5, 2)], "test_id bigint, rank int, distance double, cls int")
    assert neighbors.vote(tie).first().cls == 2


def test_overlaps_match_brute_force(spark):
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    left = {i: sorted(set(RANDOM.choices(vocabulary, weights, k=RANDOM.randrange(1, 25)))) for i in range(60)}
    right = {i: sorted({"w0", *RANDOM.choices(vocabulary, weights, k=RANDOM.randrange(1, 40))}) for i in range(90)}
    pairs = [(-len(set(a) & set(b)), i, j) for (i, a), (j, b) in itertools.product(left.items(), right.items())]
    expected = [(i, j, -s) for s, i, j in sorted(p for p in pairs if p[0] < 0)]
    a = spark.createDataFrame(list(left.items()), "l bigint, words array<string>")
    b = spark.createDataFrame(list(right.items()), "r bigint, words array<string>")
    for number in (1, 40, 3000, 10_000):
        rows = top_overlaps(a, b, "l", "r", number).collect()
        assert [(r.l, r.r, r.score) for r in rows] == expected[:number]


def test_overlaps_of_many_copies(spark):
    left = {i: ["a", "b", "c"] if i % 3 else [f"x{i}", "a"] for i in range(60)}
    right = {i: ["b", "c", "d"] if i % 3 else [f"x{i}", "a", "z"] for i in range(90)}
    pairs = [(-len(set(a) & set(b)), i, j) for (i, a), (j, b) in itertools.product(left.items(), right.items())]
    expected = [(i, j, -s) for s, i, j in sorted(p for p in pairs if p[0] < 0)]
    a = spark.createDataFrame(list(left.items()), "l bigint, words array<string>")
    b = spark.createDataFrame(list(right.items()), "r bigint, words array<string>")
    for number in (3, 70, 500, 100_000):
        rows = top_overlaps(a, b, "l", "r", number).collect()
        assert [(r.l, r.r, r.score) for r in rows] == expected[:number]


def test_overlap_without_common_words(spark):
    a = spark.createDataFrame([(1, ["x"])], "l bigint, words array<string>")
    b = spark.createDataFrame([(1, ["y"])], "r bigint, words array<string>")
    assert top_overlaps(a, b, "l", "r", 5).collect() == []


@pytest.mark.parametrize("limit", [0, 10_000])
def test_fan_out(spark, limit):
    inputs = spark.range(40).withColumnRenamed("id", "input")
    keys = spark.range(1203).selectExpr("concat('k', lpad(id, 5, '0')) AS key")
    out = verbs.fan_out(inputs, keys, ["key"], limit)
    assert out.count() == out.select("input", "key").distinct().count() == 40 * 1203
    row = out.where("key = 'k00700' AND input = 3").first()
    assert (row.file_id, row.num_files) == (701, 1203)


def test_split_ranges(spark):
    df = spark.createDataFrame([(i, 1) for i in range(36)], "i int, size bigint")
    counts = {r.chunk: r["count"] for r in verbs.split_by_size(df, ["i"], F.col("size"), 20).groupBy("chunk").count().collect()}
    assert counts == {1: 20, 2: 16}


def test_pivots_of_scores(spark):
    df = spark.createDataFrame([(v,) for v in (71, 12, 55, 40, 33)], "score bigint")
    assert sorted(r.boundary for r in sorting.pivots(df, "score", 2).collect()) == [12, 40, 72]


def test_pivots_with_more_bins_than_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert sorted(r.boundary for r in sorting.pivots(df, "v", 8).collect()) == [1, 3]


def test_pivot_merge_keeps_the_ends(spark):
    lists = [3, 14, 15, 92, 65, 35, 8, 97, 9, 32, 3, 84, 62]
    df = spark.createDataFrame([(float(v),) for v in lists], "boundary double")
    union = sorted(set(map(float, lists)))
    expected = sorted({union[min(round(i * len(union) / 5), len(union) - 1)] for i in range(5)} | {union[-1]})
    assert [r.boundary for r in sorting.merge_pivots(df, 5).orderBy("boundary").collect()] == expected
    ranges = sorting.pivot_ranges(sorting.merge_pivots(df, 5)).orderBy("bin").collect()
    assert [(r.lo, r.hi) for r in ranges] == list(zip(expected, expected[1:]))


def test_bin_column(spark):
    bounds = [0.0, 10.0, 15.0, 23.0, 40.0]
    df = spark.createDataFrame([(float(v) / 2,) for v in range(-4, 90)], "v double")
    for row in df.select("v", sorting.bin_column(F.col("v"), bounds).alias("b")).collect():
        expected = [i + 1 for i in range(4) if bounds[i] <= row.v < bounds[i + 1]]
        assert row.b == (expected[0] if expected else None)


def test_sort_keeps_all_rows_in_order(skewed):
    laid = sorting.sort_range(skewed.select("v", "id"), "v", "id").withColumn("p", F.spark_partition_id()).collect()
    assert len(laid) == 6000
    assert [(r.v, r.id) for r in laid] == sorted((r.v, r.id) for r in laid)
    assert max(sum(r.p == p for r in laid) for p in {r.p for r in laid}) < 3000


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


@pytest.mark.parametrize("limit", [0, 100])
def test_points_in_polygons(spark, limit):
    rings = {f"p{i}": [(RANDOM.uniform(0, 300), RANDOM.uniform(-300, 300)) for _ in range(RANDOM.randrange(3, 8))] for i in range(12)}
    spots = [(i, RANDOM.uniform(0, 300), RANDOM.uniform(-300, 300)) for i in range(300)]
    shapes = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in r]) for n, r in rings.items()], "name string, vertices array<struct<x double, y double>>")
    points = spark.createDataFrame(spots, "id bigint, x double, y double")
    found = polygons.pair_with_polygons(points, shapes, polygons.inside(F.col("vertices"), F.col("x"), F.col("y")), limit=limit)
    rows = [(r.id, r.name) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(i, n) for i, x, y in spots for n, r in rings.items() if inside(r, x, y)}


def test_window_is_padded_at_the_edge(spark):
    cells = spark.createDataFrame([(x, y, 10 * y + x + 1) for x in range(3) for y in range(3)], "x int, y int, v int")
    rows = {(r.x, r.y): r.features for r in grids.window_features(cells, "v").collect()}
    assert rows[0, 0] == [0, 0, 0, 0, 1, 2, 0, 11, 12]
    assert rows[1, 1] == [1, 2, 3, 11, 12, 13, 21, 22, 23]
    assert grids.window_features(cells, "v", outside=255).where("x = 0 AND y = 0").first().features[0] == 255


def test_borders_are_cleaned_at_once(spark):
    border = {(0, 0), (5, 5), (5, 6)}
    cells = spark.createDataFrame([(x, y, 1 if (x, y) in border else 0) for x in range(8) for y in range(8)], "x int, y int, cls int")
    rows = {(r.x, r.y): r.cls for r in grids.clean_borders(cells).collect()}
    assert rows[0, 0] == 2 and rows[5, 5] == rows[5, 6] == 1 and rows[7, 7] == 0 and len(rows) == 64


def test_match_prefers_the_smallest_key(spark):
    ties = spark.createDataFrame([("b", 0), ("a", 0), ("c", 0)], "key string, score int")
    assert verbs.match(ties, "key", "score").first().key == "a"
    assert verbs.match_within(ties.withColumn("g", F.lit(1)), ["g"], "key", "score").first().key == "a"


def test_balanced_classes(spark):
    df = spark.createDataFrame([(i, "rare" if i < 5 else "hot") for i in range(500)], "id bigint, label string")
    counts = {r.label: r["count"] for r in reports.balanced(df, "label", "id").groupBy("label").count().collect()}
    assert counts == {"rare": 5, "hot": 5}


def test_part_lists_are_paged(spark):
    df = spark.createDataFrame([("h", i) for i in range(25)] + [("k", 1)], "host string, page_id int")
    rows = {(r.host, r.page): (r.n, r.parts) for r in reports.part_lists(df, "host", "page_id", 10).collect()}
    assert rows["h", 0] == (10, ",".join(map(str, range(10)))) and rows["h", 2] == (5, "20,21,22,23,24") and rows["k", 0] == (1, "1")


def test_pipe_retries_and_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "line string").coalesce(1)
    out = verbs.pipe_through(df, "line", ["sh", "-c", "exit 1"], retry=["sed", "s/^/x/"], name="out")
    assert sorted(r.out for r in out.collect()) == ["xa", "xb"]
    with pytest.raises(Exception, match="failed with 3"):
        verbs.pipe_through(df, "line", ["sh", "-c", "exit 3"]).collect()


def test_one_program_per_task(spark):
    """Answers line by line, only at the end, or from a program that stops reading; many batches, more than a pipe holds."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        df = spark.range(0, 120_000, 1, 3).select(F.concat(F.lit("row-"), F.lpad("id", 30, "0")).alias("line"))
        echoed = verbs.pipe_through(df, "line", ["cat"])
        assert echoed.count() == 120_000 and echoed.exceptAll(df).count() == 0
        assert [int(r.line) for r in verbs.pipe_through(df, "line", ["wc", "-l"]).collect()] == [40_000] * 3
        backwards = verbs.pipe_through(df.coalesce(1), "line", ["sort", "-r"]).collect()
        assert len(backwards) == 120_000 and backwards[0].line.endswith("119999")
        assert verbs.pipe_through(df, "line", ["head", "-n", "1"]).count() == 3
        # Twice as much out as in, and the answers of a first program that fails late are not used.
        assert verbs.pipe_through(df, "line", ["sed", "p"]).count() == 240_000
        again = verbs.pipe_through(df, "line", ["sh", "-c", "cat; exit 1"], retry=["sed", "s/^/x/"])
        assert again.count() == 120_000 and again.where("line LIKE 'x%'").count() == 120_000
        assert verbs.pipe_through(df, "line", ["cat"], retry=["false"]).count() == 120_000
        assert len(verbs.pipe_through(df, "line", ["cat"]).limit(5).collect()) == 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    odd = spark.createDataFrame([(None,), ("",), ("é",)], "line string").coalesce(1)
    assert [r.line for r in verbs.pipe_through(odd, "line", ["cat"]).collect()] == ["", "", "é"]
    assert verbs.pipe_through(odd.limit(0), "line", ["false"]).count() == 0


def test_summaries_merge_to_even_bins(spark):
    """Chunks of different days: ranks of the merged boundaries against exact ones, one value with a third of the rows."""
    values = [RANDOM.gauss(0, 50) if i % 3 else 7.0 for i in range(30_000)]
    df = spark.createDataFrame([(i % 11, "a", v) for i, v in enumerate(values)] + [(0, "b", None), (1, "c", 4.0), (2, "c", 4.0)], "day int, g string, v double")
    days = [session.materialize(sorting.summaries(df.where(F.col("day") == k), "v", ["g"])) for k in range(11)]
    left, right = verbs.combine(*days[:4]), verbs.combine(*days[4:])
    merged = sorting.merge_summaries(verbs.combine(*[sorting.merge_summaries(part, ["g"]) for part in (left, right)]), ["g"])
    assert {r.g: r.n for r in merged.collect()} == {"a": 30_000, "c": 2}
    found = sorting.summary_pivots(merged, 10, ["g"]).collect()
    edges, order = sorted(r.boundary for r in found if r.g == "a"), sorted(values)
    assert edges[-1] == order[-1] + 1 and sorted(r.boundary for r in found if r.g == "c") == [4.0, 5.0]
    # A boundary stands for a wanted rank when that lies between its first and last place, or nearly.
    for i in range(1, 10):
        assert min(max(bisect.bisect_left(order, e) - 3000 * i, 3000 * i - bisect.bisect_right(order, e), 0) for e in edges) <= 0.005 * len(order)
    assert sorting.merge_summaries(sorting.summaries(df.limit(0), "v")).count() == 0
    assert sorting.summary_pivots(sorting.merge_summaries(sorting.summaries(df.limit(0), "v", ["g"]), ["g"]), 4, ["g"]).count() == 0


def test_application_may_return_nothing(spark):
    assert verbs.run(spark.range(10), lambda batch, params: None, "id bigint").count() == 0


def test_flow_chain(spark):
    df = spark.range(100).selectExpr("id", "id % 10 AS score")
    keys = spark.createDataFrame([("x",), ("y",)], "key string")

    def double(batch, params):
        batch["score"] = batch["score"] * params["by"]
        return batch

    out = (
        Flow(df).top("score", 20, "id").run(double, "id bigint, score bigint", {"by": 2})
        .map(lambda pairs: pairs.groupBy("key").agg(F.sum("score").alias("score")), keys, ["key"])
        .combine(spark.createDataFrame([("z", 1)], "key string, score bigint"), sort=["score"]).result().collect()
    )
    assert [(r.key, r.score) for r in out][0] == ("z", 1)
    assert {r.key: r.score for r in out} == {"x": 2 * (10 * 9 + 10 * 8), "y": 2 * (10 * 9 + 10 * 8), "z": 1}
    assert Flow(df).match("id", "score").result().first().id == 9
    assert [r.id for r in Flow(df).sort("score", "id", num_bins=3).result().limit(3).collect()] == [0, 10, 20]
    assert Flow(df).split(["id"], 30).result().select("chunk").distinct().count() == 4
    assert Flow(df).partition("score", 2).result().count() >= 2


def test_nth_sample_and_exclusion(spark):
    listed = spark.createDataFrame([(1,), (1,), (3,)], "id bigint")
    assert sorted(r.id for r in verbs.exclude(spark.range(5), listed, ["id"]).collect()) == [0, 2, 4]


def test_deadline(spark):
    df = spark.createDataFrame([(1, 0), (1, 200), (1, 50), (0, 50)], "again int, execute int")
    kept = verbs.before_deadline(df, F.col("again"), F.col("execute"), F.lit(100)).collect()
    assert [(r.again, r.execute) for r in kept] == [(1, 0), (1, 200), (0, 50)]


def near(ring, x, y):
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = bx - ax, by - ay
        cross, dot = (y - ay) * dx - (x - ax) * dy, (x - ax) * dx + (y - ay) * dy
        if (x, y) in ((ax, ay), (bx, by)) or (abs(cross) <= 10 and 0 <= dot <= dx * dx + dy * dy):
            return True
    return False


def test_points_near_edges_across_cells(spark):
    rings = {"wide": [(10.0, 10.0), (200.0, 15.0), (90.0, 180.0)], "tiny": [(50.0, 50.0), (50.5, 50.0), (50.2, 50.7)]}
    spots = [(i, RANDOM.uniform(0, 250), RANDOM.uniform(0, 250)) for i in range(400)]
    spots += [(1000 + i, 50.2 + i, 50.1 + i / 3) for i in range(30)] + [(2000, 10.0, 10.0)]
    shapes = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in r]) for n, r in rings.items()], "name string, vertices array<struct<x double, y double>>")
    points = spark.createDataFrame(spots, "id bigint, x double, y double")
    hit = polygons.near_edge(F.col("vertices"), F.col("x"), F.col("y"))
    found = polygons.pair_with_polygons(points, shapes, hit, margin=polygons.reach(F.col("vertices")))
    rows = [(r.id, r.name) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(i, n) for i, x, y in spots for n, r in rings.items() if near(r, x, y)}


def test_shuffles_grow_with_the_input(spark, tmp_path, monkeypatch):
    from sluiceflow import session

    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "PARTITION_BYTES", max(1, session.input_bytes(df) // 40))
    with session.sized_shuffles(df):
        assert df.repartitionByRange("id").rdd.getNumPartitions() >= 39
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_neighbours_hold_no_more_than_tiles(spark, monkeypatch):
    """All pairs of a block may be tied, and a vector may be sent to all cells; neither is held at once."""
    same = np.ones((1500, 64))
    ids = np.arange(1500)
    tracemalloc.start()
    found = neighbors.block_nearest(ids, same, ids, same, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    assert found.groupby("test_id")["train_id"].apply(list).to_dict() == {i: [j for j in range(6) if j != i][:5] for i in range(1500)}

    monkeypatch.setattr(neighbors, "_TILE", 40)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 4)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vec array<double>")
    got = {}
    for r in neighbors.nearest(df, df, 5, skip_same=True, limit=0, pivots=8, block=40).collect():
        got.setdefault(r.test_id, {})[r["rank"]] = r.train_id
    pairs = list(enumerate(vectors))
    assert {i: [ranks[r] for r in sorted(ranks)] for i, ranks in got.items()} == brute_neighbours(pairs, pairs, 5, True)
    frames = list(neighbors.sliced([pd.DataFrame({"id": range(100)})], 8))
    assert [len(f) for f in frames] == [5] * 20


def test_partial_neighbours_do_not_grow_with_training_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    for block in (20, 200):
        partial = neighbors._by_cells(df, df, 5, True, 4, block)
        assert partial.count() <= 2 * 600 * 5
        got = {(r.test_id, r["rank"]): r.train_id for r in neighbors.merge_nearest(partial, 5).collect()}
        vectors = np.array([v for _, v in rows])
        away = ((vectors[:, None] - vectors[None]) ** 2).sum(2)
        np.fill_diagonal(away, np.inf)
        assert all(got[i, k + 1] == j for i, line in enumerate(away.argsort(axis=1, kind="stable")[:, :5].tolist()) for k, j in enumerate(line))


def test_one_huge_outline_among_small_ones(spark):
    """An extent of a million beside extents of one: few cells each, no grid over the large one."""
    rng = random.Random(3)
    square = lambda x, y, side: [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    shapes = [("huge", square(-5e5, -5e5, 1e6)), ("point", [(7.5, 7.5)]), ("empty", [])]
    shapes += [(f"s{k}", square(rng.uniform(-5e5, 5e5), rng.uniform(-5e5, 5e5), 1.0)) for k in range(3000)]
    spots = [(0, 7.5, 7.5), (1, None, 0.0), (2, 6e5, 0.0)] + [(3 + k, v[0][0] + 0.5, v[0][1] + 0.25) for k, (_, v) in enumerate(shapes[3:])]
    table = spark.createDataFrame([(n, [dict(x=a, y=b) for a, b in v]) for n, v in shapes], "name string, vertices array<struct<x:double,y:double>>")
    points = spark.createDataFrame(spots, "id long, x double, y double")
    for limit in (0, 10_000):
        hit = polygons.inside(F.col("vertices"), F.col("x"), F.col("y"))
        found = {(r.name, r.id) for r in polygons.pair_with_polygons(points, table, hit, limit=limit).collect()}
        want = {("huge", i) for i, x, y in spots if x is not None and abs(x) <= 5e5}
        for name, v in shapes[3:]:
            want |= {(name, i) for i, x, y in spots if x is not None and v[0][0] <= x <= v[2][0] and v[0][1] <= y <= v[2][1]}
        assert found == want


def test_range_join_with_many_boundaries(spark):
    rng = random.Random(4)
    edges = sorted({rng.randrange(10_000) / 4 for _ in range(2500)})
    values = [rng.randrange(-100, 11_000) / 4 for _ in range(6000)] + [None, edges[0], edges[-1]]
    rows = spark.createDataFrame([(i, v, "b") for i, v in enumerate(values)], "lo long, v double, bin string").toDF("id", "v", "boundary")
    table = spark.createDataFrame([(e,) for e in edges * 2] + [(None,)], "boundary double")
    got = {r.id: (r.bin, r.lo, r.hi) for r in sorting.range_join(rows, "v", table).collect()}
    for i, v in enumerate(values):
        k = bisect.bisect_right(edges, v) if v is not None else 0
        assert got[i] == ((k, edges[k - 1], edges[k]) if 0 < k < len(edges) else (None, None, None))
    assert len(got) == len(values)
    assert sorting.range_join(rows, "v", table.where("false")).where("bin IS NULL").count() == len(values)


def test_least_after_goes_over_a_piece_once(spark):
    """A frame up to a piece's end is gone over anew for every row: minutes for these rows in one piece, and a billion steps."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 7 == 3, F.pmod(F.xxhash64("id"), F.lit(10**6)) + F.col("id") * 100).alias("v"))
    laid = Ordered(rows.coalesce(1), ["id"])
    out = laid.extend(least_after={"ahead": F.col("v")})
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.id: r.ahead for r in out.select("id", "ahead").collect()}
    least = None
    for r in sorted(rows.collect(), key=lambda r: -r.id):
        least = r.v if least is None or (r.v is not None and r.v < least) else least
        assert got[r.id] == least


def test_latest_and_least_after_cross_pieces(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, rng.random()])) for g in (1, 2, 3) for i in range(400 if g == 2 else 30)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    got = {(r.g, r.i): (r.seen, r.ahead) for r in Ordered(df, ["i"], ["g"]).extend(latest={"seen": F.col("v")}, least_after={"ahead": F.col("v")}).collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j <= i and v is not None]
        after = [v for h, j, v in rows if h == g and j >= i and v is not None]
        assert got[g, i] == (before[-1] if before else None, min(after, default=None))


def test_wide_keys_are_not_copied_to_every_executor(spark, monkeypatch):
    keys = spark.createDataFrame([(k, "x" * 1000) for k in range(700)], "k int, wide string")
    inputs = spark.range(20).toDF("i")
    monkeypatch.setattr(verbs, "at_most", lambda df, limit: session.at_most(df, limit, 100_000))
    out = verbs.fan_out(inputs, keys, ["k"])
    # The only copied table is that of one row per partition, which numbers the keys.
    assert out._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == 1
    assert out.count() == 14_000 and out.select("file_id").distinct().count() == 700


@pytest.mark.parametrize(("limit", "size"), [(10_000, 8_000_000), (7, 8_000_000), (10_000, 150), (1, 1)])
def test_panels_beyond_what_is_copied(spark, limit, size):
    letters = "abcdefghij"
    found = [(f"s{i:02d}", sorted(RANDOM.sample(letters, 4))) for i in range(30)]
    rows = [(i % 3, RANDOM.sample(letters, RANDOM.randrange(6))) for i in range(40)] + [(None, None)]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    got = best_panel(df, F.col("w"), spark.createDataFrame(found, "species string, words array<string>"), "best", limit, size).collect()

    def plain(words):
        return max(((len(set(words) & set(p)), s) for s, p in found), key=lambda e: (e[0], [-ord(c) for c in e[1]]))

    key = lambda r: (r[0] is None, r[0] or 0, r[1] or [])
    expected = sorted(((k, w, plain(w)) for k, w in rows if w is not None), key=key)
    assert sorted(((r.k, r.w, tuple(r.best)) for r in got if r.w is not None), key=key) == expected
    assert len(got) == len(rows)


def test_long_gaps_are_cut(spark, monkeypatch):
    monkeypatch.setattr(curves, "GAP_STEPS", 3)
    curve = spark.createDataFrame([("a", 0, 1), ("a", 25, 2), ("a", 26, 3), ("b", 5, 7), ("b", 11, 8)], "k string, t bigint, active int")
    got = sorted((r.k, r.t, r.active) for r in curves.fill_gaps(curve, 2, ["k"]).collect())
    assert got == [*[("a", t, 1) for t in range(0, 25, 2)], ("a", 25, 2), ("a", 26, 3), ("b", 5, 7), ("b", 7, 7), ("b", 9, 7), ("b", 11, 8)]


def test_normal_curve_of_nothing_and_of_one_value(spark):
    for rows in ([], [(None,)]):
        assert curves.normal_cdf(spark.createDataFrame(rows, "v double"), F.col("v"), 5).collect() == []
    same = curves.normal_cdf(spark.createDataFrame([(4.0,), (4.0,)], "v double"), F.col("v"), 3).collect()
    assert [tuple(r) for r in same] == [(0, 4.0, 1.0), (1, 4.0, 1.0), (2, 4.0, 1.0)]


def test_scored_words_are_not_held_for_a_batch():
    texts = [" ".join(str(n % 700 + i) for n in range(2000)) for i in range(800)]
    batch = pd.DataFrame({"doc_id": range(801), "source": "s", "n_chars": 1, "text": [*texts, " a  a"]})
    tracemalloc.start()
    found = count_words(batch, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
    assert found["words"].tolist() == [2000] * 800 + [4] and found["distinct"].tolist() == [700] * 800 + [2]
    assert count_words(batch.iloc[:1].assign(text=None), {})["words"].isna().all()
