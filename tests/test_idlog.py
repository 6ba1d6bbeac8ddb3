"""The log of handled ids: exact for ever, and reading little of itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.sources.folders import remove
from vellum.streaming import idlog
from vellum.streaming.idlog import IdLog, Segment
from vellum.streaming.runners import once


def ids(spark, low, high):
    return spark.range(low, high).select(F.md5(F.col("id").cast("string")).alias("id"))


def test_filters_have_no_false_no():
    r = np.random.default_rng(1)
    held, other = r.integers(-(2**62), 2**62, (2, 20_000)), r.integers(-(2**62), 2**62, (2, 200_000))
    bloom = idlog.bloom_filter(*held)
    assert idlog.maybe_held(bloom, *held).all() and idlog.maybe_held(bloom, *other).mean() < 1e-3
    assert not idlog.maybe_held(idlog.bloom_filter(*held[:, :0]), *other[:, :100]).any()


def test_lookup_is_exact_and_reads_few_folders(spark, tmp_path):
    log = IdLog(spark, f"{tmp_path}/log", folder_ids=2_000)
    log.add(ids(spark, 0, 100_000), 0)
    log.add(ids(spark, 100_000, 100_500), 1)
    assert [s.folders for s in log.segments()] == [50, 1]
    # new ids only: no folder of ids has to be read but for a rare "maybe"
    fresh = ids(spark, 200_000, 210_000)
    assert log.suspects(fresh)[0].count() <= 5 and log.known(fresh).count() == 0
    # a few old ones among them
    mixed = fresh.union(ids(spark, 50_000, 50_003)).union(ids(spark, 100_499, 100_500))
    places = log.suspects(mixed)[0].select("segment", "folder").distinct().collect()
    assert 1 <= len(places) <= 9
    want = {r.id for r in ids(spark, 50_000, 50_003).union(ids(spark, 100_499, 100_500)).collect()}
    assert {r.id for r in log.known(mixed).collect()} == want
    scan = log._read(log.ids_at, idlog._IDS, log.suspects(mixed)[0], log.segments())
    assert scan.rdd.getNumPartitions() <= 9 and scan.count() < 25_000
    # batches before one
    assert log.known(mixed, 1).count() == 3 and log.known(mixed, 0).count() == 0


def test_merging_keeps_every_id(spark, tmp_path):
    log = IdLog(spark, f"{tmp_path}/log", folder_ids=50, fan=3)
    for batch in range(10):
        log.compact()
        log.add(ids(spark, batch * 20, batch * 20 + 20), batch)
    log.compact()
    kept = log.segments()
    assert len(kept) < 10 and sum(s.ids for s in kept) == 200 and (kept[0].low, kept[-1].high) == (0, 9)
    assert all(a.high + 1 == b.low for a, b in zip(kept, kept[1:])) and max(s.folders for s in kept) > 1
    assert log.known(ids(spark, 0, 300)).count() == 200
    # a repeated batch takes the place of its former self
    log.add(ids(spark, 500, 510), 10)
    log.add(ids(spark, 600, 610), 10)
    assert log.known(ids(spark, 500, 700)).count() == 10
    log.add(ids(spark, 0, 0), 11)
    assert log.segments()[-1].high == 10


def test_unfinished_segments_do_not_count(spark, tmp_path):
    log = IdLog(spark, f"{tmp_path}/log", fan=2)
    log.add(ids(spark, 0, 10), 0)
    log.add(ids(spark, 10, 20), 1)
    merged = Segment(0, 1, 20, 1)
    ids(spark, 0, 5).withColumn("folder", F.lit(0)).write.partitionBy("folder").parquet(f"{log.ids_at}/{merged.name}")
    assert len(log.segments()) == 2 and log.known(ids(spark, 0, 20)).count() == 20
    # the writer comes again; the parts may be removed in any order afterwards
    assert len(log.compact()) == 2 and log.segments() == [merged] and log.known(ids(spark, 0, 30)).count() == 20
    remove(spark, f"{log.ids_at}/{Segment(0, 0, 10, 1).name}")
    assert log.known(ids(spark, 0, 30)).count() == 20


@pytest.mark.parametrize("fail", [False, True])
def test_effect_happens_once(spark, tmp_path, fail):
    """Duplicates inside a batch, over batches and over a crash between the effect and its mark."""
    folder, seen = str(tmp_path), {}

    def effect(fresh, number):
        seen[number] = sorted(r.id for r in fresh.collect())

    step = once(effect, f"{folder}/processed")
    rows = lambda *given: spark.createDataFrame([(i, t) for i, t in given], "id string, t string").select("id", F.col("t").cast("timestamp").alias("occurred_at"))
    step(rows(("a", "2020-01-01"), ("a", "2020-01-02"), ("b", "2020-01-01")), 0)
    if fail:
        IdLog(spark, f"{folder}/processed")._drop(IdLog(spark, f"{folder}/processed").segments()[0])
    step(rows(("a", "2020-01-01"), ("b", "2020-01-01"), ("a", "2020-01-03")), 0)
    step(rows(("b", "2020-01-05"), ("c", "2020-01-01"), ("a", "2019-01-01")), 1)
    assert seen == {0: ["a", "b"], 1: ["c"]}
