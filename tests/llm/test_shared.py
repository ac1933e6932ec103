"""Batches of Arrow streams, rows that pass whole, and components."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.llm.arrow import by_key, keep_rows, slices, whole_groups
from tidepool.llm.components import connected_components, joined_components
from tidepool.llm.shared import Scratch
from test_pairs import components


@pytest.mark.parametrize("seed", range(5))
def test_groups_stay_whole(seed):
    rng = random.Random(seed)
    keys = sorted(rng.choices(range(12), k=rng.randrange(0, 90)))
    whole = pa.record_batch({"k": pa.array(keys, pa.int64()), "v": pa.array(range(len(keys)), pa.int64())})
    cuts = sorted({0, len(keys), *(rng.randrange(0, len(keys) + 1) for _ in range(8))})
    batches = [whole.slice(a, z - a) for a, z in zip(cuts, cuts[1:])] + [whole.slice(0, 0)]
    runs = list(by_key(iter(batches), "k"))
    assert [k for k, _ in runs] == sorted(set(keys)) and [v for _, b in runs for v in b["v"].to_pylist()] == list(range(len(keys)))
    groups = list(whole_groups(iter(batches), "k", 10))
    assert [v for b in groups for v in b["v"].to_pylist()] == list(range(len(keys)))
    seen = [set(b["k"].to_pylist()) for b in groups]
    assert sum(map(len, seen)) == len(set(keys))
    assert all(b.num_rows <= 7 for b in slices(iter(batches), 7))


def test_rows_keep_all_their_columns(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("text"), F.array(F.col("id")).alias("a b"), F.lit(None).cast("double").alias("TEXT2"))
    kept = keep_rows(df, "text", lambda: lambda xs: [x.endswith("3") for x in xs])
    assert kept.schema.names == df.schema.names and sorted(r.id for r in kept.collect()) == [3, 13, 23, 33, 43]


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(5, 5), (7, None)],
        "path": [(k, k + 1) for k in random.Random(2).sample(range(60), 60)],
        "star": [(100, k) for k in range(90)],
        "none": [],
    }[shape]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()}
    links = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == components({x for e in links for x in e}, links)


def test_components_by_broadcast_and_by_salts(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(0, x) for x in range(1, 200)] + [(rng.randrange(600), rng.randrange(600)) for _ in range(300)]
    want = components({x for e in edges if e[0] != e[1] for x in e}, edges)
    for rows in (0, 500_000):
        monkeypatch.setattr("tidepool.llm.shared.BROADCAST_ROWS", rows)
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()}
        assert got == want, rows


def test_joined_components_equal_those_of_all_links(spark):
    scratch = Scratch(spark, "t")
    first, more = [(1, 2), (3, 4), (5, 6)], [(2, 4), (7, 8), (9, 6), (8, 7), (1, 2), (5, 5)]
    roots = scratch.save(connected_components(spark.createDataFrame(first, "src long, dst long"), scratch), "roots")
    links = scratch.save(spark.createDataFrame(more, "src long, dst long"), "links")
    got = {r.node: r.root for r in joined_components(roots, links, scratch, "all").collect()}
    assert got == components(range(1, 10), first + more)
    within = scratch.save(spark.createDataFrame([(2, 1), (6, 5)], "src long, dst long"), "within")
    assert joined_components(roots, within, scratch, "within") is roots
    none = scratch.save(roots.limit(0), "no-roots")
    assert {r.node: r.root for r in joined_components(none, links, scratch, "new").collect()} == components([1, 2, 4, 6, 7, 8, 9], [e for e in more if e != (5, 5)])


def test_components_of_few_edges_take_few_tasks(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    edges = spark.createDataFrame([(0, x) for x in range(1, 300)] + [(x, x + 1) for x in range(300, 308)] + [(5, 303)], "src long, dst long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "components")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.root for r in connected_components(edges, Scratch(spark, "t")).collect()}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("components")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs if j for s in j.stageIds}
    done = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert got == {0} and done < 40 * 20
