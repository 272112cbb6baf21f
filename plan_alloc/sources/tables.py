"""Reading inputs and writing the result bundle (``src_*``, ``snk_*``).

Inputs: CSV (header; every column read as text, no inference pass over the
data — the standardising step types periods and numbers; malformed lines are
kept, see ``csv_text``), Parquet, or a catalog table. Output: the four result tables under one run folder, the two
row-level ones partitioned by ``period`` so later reads can prune months.

A run is published all at once. Its tables are written to a staging folder of the
run's own; only when all four are complete does one small manifest file, created
under the run's name, say where they are. Creating it fails if the name is taken,
so of two writers of one name one wins and nothing of the other is ever seen.
Readers go by manifests only: a killed or failed writer leaves staging files,
which no reader looks at and ``remove_unpublished`` deletes.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from plan_alloc.sources.csv_text import read_csv
from plan_alloc.spec import DataError

# Names of the four result tables, in writing order.
BUNDLE_TABLES = ("final_allocations", "group_summary", "sku_variance", "integrity_summary")
PARTITIONED = {"final_allocations": "period", "sku_variance": "period"}
FORMATS = ("csv", "parquet", "table")


def input_format(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return "csv"
    if suffix == ".parquet":
        return "parquet"
    raise DataError(f"Unsupported input '{path}': use a .csv or .parquet path, or format='table'.")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """``src_csv``/``src_table``/``src_reject_format``. ``multi_line``: quoted CSV
    fields may hold line breaks (a file is then read by one task)."""
    fmt = fmt or input_format(path)
    if fmt not in FORMATS:
        raise DataError(f"Unsupported input format '{fmt}'; expected one of {', '.join(FORMATS)}.")
    if fmt == "table":
        return spark.table(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    return read_csv(spark, path, multi_line)


def run_id(now: datetime | None = None) -> str:
    """``snk_name``: a UTC timestamp, and a random part that keeps apart the runs of one moment."""
    return f"{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:12]}"


def check_bundle(tables: dict[str, DataFrame]) -> None:
    """``snk_check``: all four tables present, each a DataFrame with columns."""
    for name in BUNDLE_TABLES:
        df = tables.get(name)
        if not isinstance(df, DataFrame):
            raise DataError(f"Result table '{name}' must be a Spark DataFrame.")
        if not df.columns:
            raise DataError(f"Result table '{name}' has no columns.")


def write_bundle(
    tables: dict[str, DataFrame],
    base: str,
    fmt: str = "parquet",
    run: str | None = None,
    rebalance: bool = True,
) -> dict[str, str]:
    """``snk_bundle``/``snk_csv``: write the four tables and publish them as one
    run; return their paths. Raises if the run id has been published.

    ``rebalance`` (default): before a ``period``-partitioned write, let AQE
    rebalance the rows by period (one shuffle of the output that splits big
    periods and merges small ones), so each period folder gets a few
    well-sized files instead of one file per task and period — tasks × periods
    small files otherwise.
    """
    check_bundle(tables)
    if fmt not in ("csv", "parquet"):
        raise DataError(f"Unsupported output format '{fmt}'.")
    base, run = base.rstrip("/"), run or run_id()
    if not run.replace("_", "").replace("-", "").replace(".", "").isalnum() or run.startswith("."):
        raise DataError(f"Run id '{run}' is not a plain name.")
    spark = tables[BUNDLE_TABLES[0]].sparkSession
    if _read_text(spark, _manifest(base, run)) is not None:
        raise DataError(f"Run '{run}' has been published already.")
    staging = f"{base}/{STAGING}/run={run}.{uuid.uuid4().hex}"
    paths = {name: f"{staging}/{name}" for name in BUNDLE_TABLES}

    def write_one(name: str) -> None:
        df = tables[name]
        part = PARTITIONED.get(name)
        if part is not None and part in df.columns:
            if rebalance:
                df = df.hint("rebalance", part)
            writer = df.write.mode("error").partitionBy(part)
        else:
            writer = df.write.mode("error")
        if fmt == "csv":
            writer.option("header", True).csv(paths[name])
        else:
            writer.parquet(paths[name])

    try:
        # The four writes are independent jobs over the same (cached) inputs:
        # submitted together, Spark runs their stages side by side.
        with ThreadPoolExecutor(max_workers=len(BUNDLE_TABLES)) as pool:
            for future in [pool.submit(write_one, name) for name in BUNDLE_TABLES]:
                future.result()
        _create_text(spark, _manifest(base, run), json.dumps({"run": run, "format": fmt, "tables": {n: p[len(base) + 1 :] for n, p in paths.items()}}))
    except Exception:
        _delete(spark, staging)  # of a writer that lives to say so; a killed one's files are never listed
        raise
    return paths


# --------------------------------------------------------------------------
# published runs
# --------------------------------------------------------------------------
STAGING, PUBLISHED = "_staging", "_published"


def _manifest(base: str, run: str) -> str:
    return f"{base}/{PUBLISHED}/{run}.json"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears under its name complete, or not at all. Its name is claimed
    first, by creating a hidden file that must not exist; then it is written
    beside it and renamed."""
    folder, name = path.rsplit("/", 1)
    claim, fs = _file_system(spark, f"{folder}/.{name}.claim")
    taken = DataError(f"'{path}' is taken: another writer publishes this run.")
    if fs.exists(claim):
        raise taken
    try:
        fs.create(claim, False).close()
    except Exception as err:
        raise taken from err
    beside, _ = _file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(beside, _file_system(spark, path)[0]):
        raise DataError(f"'{path}' could not be written.")


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def published_runs(spark: SparkSession, base: str) -> list[str]:
    """Ids of the runs published under ``base``, in the order of their names."""
    folder, fs = _file_system(spark, f"{base.rstrip('/')}/{PUBLISHED}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))


def read_bundle(spark: SparkSession, base: str, run: str | None = None) -> dict[str, DataFrame]:
    """The four tables of a published run (the last by name if none is given)."""
    base = base.rstrip("/")
    runs = published_runs(spark, base) if run is None else [run]
    text = _read_text(spark, _manifest(base, runs[-1])) if runs else None
    if text is None:
        raise DataError(f"No published run{f' {run!r}' if run else ''} under '{base}'.")
    manifest = json.loads(text)
    out = {}
    for name, path in manifest["tables"].items():
        reader = spark.read.option("header", True) if manifest["format"] == "csv" else spark.read
        out[name] = reader.format(manifest["format"]).load(f"{base}/{path}")
    return out


def remove_unpublished(spark: SparkSession, base: str, older_than: timedelta = timedelta(days=7)) -> list[str]:
    """Delete staging folders that no manifest names and that have not been
    touched for ``older_than`` (a writer at work is younger); their names."""
    base = base.rstrip("/")
    folder, fs = _file_system(spark, f"{base}/{STAGING}")
    if not fs.exists(folder):
        return []
    before = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
    stale = [s.getPath() for s in fs.listStatus(folder) if s.getModificationTime() <= before]
    # Listed before the manifests are read: what is published meanwhile is named by one.
    named = {path.split("/")[1] for run in published_runs(spark, base) for path in json.loads(_read_text(spark, _manifest(base, run)))["tables"].values()}
    gone = [p for p in stale if p.getName() not in named]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
