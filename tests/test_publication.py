"""A run is seen complete or not at all."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plan_alloc.sources.tables import BUNDLE_TABLES, STAGING, published_runs, read_bundle, remove_unpublished, run_id, write_bundle
from plan_alloc.spec import DataError


def _tables(spark, value):
    df = spark.range(20).select(F.concat(F.lit("2026-0"), 1 + F.col("id") % 3, F.lit("-01")).cast("date").alias("period"), F.lit(value).alias("v"))
    return dict.fromkeys(BUNDLE_TABLES, df)


def _seen(spark, base, run=None):
    return {name: {r.v for r in df.select("v").distinct().collect()} for name, df in read_bundle(spark, base, run).items()}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_published_run_is_read_back(spark, tmp_path, fmt):
    base = str(tmp_path)
    write_bundle(_tables(spark, "first"), base, fmt, run="a")
    write_bundle(_tables(spark, "second"), base, fmt, run="b")
    assert published_runs(spark, base) == ["a", "b"]
    assert _seen(spark, base) == dict.fromkeys(BUNDLE_TABLES, {"second"})
    assert _seen(spark, base, "a") == dict.fromkeys(BUNDLE_TABLES, {"first"})
    assert len(rows(read_bundle(spark, base)["final_allocations"], "v")) == 20


def test_a_writer_that_fails_leaves_no_run(spark, tmp_path):
    base = str(tmp_path)
    tables = _tables(spark, "good")
    tables["sku_variance"] = tables["sku_variance"].withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_bundle(tables, base, run="r")
    assert published_runs(spark, base) == [] and os.listdir(f"{base}/{STAGING}") == []
    with pytest.raises(DataError, match="No published run"):
        read_bundle(spark, base)
    write_bundle(_tables(spark, "again"), base, run="r")
    assert _seen(spark, base, "r") == dict.fromkeys(BUNDLE_TABLES, {"again"})


def test_a_killed_writer_is_never_seen_and_is_swept_up(spark, tmp_path):
    """Staging files without a manifest, as a killed driver leaves them."""
    base = str(tmp_path)
    kept = write_bundle(_tables(spark, "kept"), base, run="kept")
    _tables(spark, "half")["final_allocations"].write.parquet(f"{base}/{STAGING}/run=dead.0/final_allocations")
    assert published_runs(spark, base) == ["kept"] and _seen(spark, base)["final_allocations"] == {"kept"}
    assert remove_unpublished(spark, base) == []  # young: its writer may be at work
    assert remove_unpublished(spark, base, older_than=timedelta(0)) == ["run=dead.0"]
    assert os.path.isdir(kept["final_allocations"]) and _seen(spark, base)["sku_variance"] == {"kept"}
    assert remove_unpublished(spark, str(tmp_path / "nothing")) == []


def test_runs_of_one_second_and_of_one_name(spark, tmp_path):
    base, now = str(tmp_path), datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    ids = [run_id(now) for _ in range(50)]
    assert len(set(ids)) == 50 and all(i.startswith("20260102_030405_") for i in ids)

    def write(value):
        try:
            write_bundle(_tables(spark, value), base, run="same")
            return value
        except DataError:
            return None

    with ThreadPoolExecutor(3) as pool:
        won = [v for v in pool.map(write, ["x", "y", "z"]) if v]
    assert len(won) == 1 and _seen(spark, base) == dict.fromkeys(BUNDLE_TABLES, set(won))
    assert len(os.listdir(f"{base}/{STAGING}")) == 1  # the losers' files are gone
    with pytest.raises(DataError, match="published already"):
        write_bundle(_tables(spark, "late"), base, run="same")
    with pytest.raises(DataError, match="plain name"):
        write_bundle(_tables(spark, "odd"), base, run="../up")
