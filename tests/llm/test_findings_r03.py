"""Intermediate tables: bounded batches, no check-sum files."""

import os
from urllib.parse import urlparse

import pyarrow as pa
import pytest

from quadloom.llm import common


SETTINGS = ("fs.file.impl", "fs.file.impl.disable.cache")


class Batches:
    """Stands for a DataFrame whose batches are given."""

    def mapInArrow(self, run, schema):
        return run


def test_batches_that_go_back_are_bounded():
    words = pa.record_batch({"n": pa.array([3, 0, 24_998], pa.int64())})

    def fn(batch):
        many = batch.column(0).to_pylist()
        return {"n": pa.array([n for n in many for _ in range(n)], pa.int64()), "s": pa.chunked_array([[str(k) for k in range(sum(many))]])}

    got = list(common.arrow_map(Batches(), fn, "n long, s string")([words, words.slice(1, 1), words.slice(0, 0)]))
    assert max(b.num_rows for b in got) <= 10_000
    assert pa.Table.from_batches(got).column("s").to_pylist() == [str(k) for k in range(25_001)]
    assert pa.Table.from_batches(got).column("n").to_pylist() == [3] * 3 + [24_998] * 24_998


def files(spark):
    return {f"{d}/{f}" for d, _, names in os.walk(urlparse(common.shared_folder(spark)).path) for f in names}


def test_intermediate_files_have_no_check_sums(spark):
    """Each check-sum file is one more process that the executor starts."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before, settings = files(spark), [conf.get(k) for k in SETTINGS]
    df = spark.range(50, numPartitions=3).selectExpr("id", "if(id % 2 = 0, null, string(id)) s")
    stored, kept = common.Stored(df), common.cut(df)
    for got in (stored.df, kept):
        assert sorted(map(tuple, got.collect())) == [(n, str(n) if n % 2 else None) for n in range(50)]
    new = files(spark) - before
    assert sum(f.endswith(".parquet") for f in new) == 3 and sum("/rdd-" in f and "/part-" in f for f in new) == 3
    assert not [f for f in new if f.endswith(".crc")]
    stored.drop()
    assert not os.path.exists(stored.path.removeprefix("file:"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|raise_error|USER_RAISED"):
        common.cut(spark.range(1).selectExpr("raise_error('no')"))
    assert [conf.get(k) for k in SETTINGS] == settings


def test_settings_come_back_after_checkpoints_that_overlap(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    settings = [conf.get(k) for k in SETTINGS]
    one, two = common.plain_files(spark), common.plain_files(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert [conf.get(k) for k in SETTINGS] == ["org.apache.hadoop.fs.RawLocalFileSystem", "true"]
    two.__exit__(None, None, None)
    assert [conf.get(k) for k in SETTINGS] == settings
