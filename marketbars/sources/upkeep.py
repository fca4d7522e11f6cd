"""Upkeep of a lake's directories: a written plan that executors work through, each directory by itself, so that a killed run can go on.

The plan has a row for each directory with the names of its files (those of one day of a series, so few). It is written
first and dealt over tasks by directory; no list of names goes through the driver. A task makes one sorted file of a
directory under a hidden name and renames it: the name, which holds the plan's own, is the mark that the directory is
done. A run that finds an unfinished plan works through that one: directories with a mark are only tidied up.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BARS_SCHEMA, KEY

DONE = "plan string, exchange string, symbol string, day date, dir string, files long, bytes long, files_after long, bytes_after long, rows long"
_NAMES = [c.split()[0] for c in DONE.split(", ")]


def planned_directories(inventory: DataFrame, days: DataFrame) -> DataFrame:
    """The directories of an inventory that hold files of some days (exchange, symbol, day), with their files."""
    rows = inventory.join(days.select(*KEY, "day"), [*KEY, "day"], "left_semi").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]+$", 1))
    return rows.groupBy(*KEY, "day", "dir").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _folder(spark, path)
    return store.exists(p)


def unfinished(spark: SparkSession, base: str) -> str | None:
    """The folder of a plan below base that was written and not worked through."""
    p, store = _folder(spark, base)
    names = [x.getPath().toString() for x in store.listStatus(p)] if store.exists(p) else []  # a folder for each run
    return next((n for n in sorted(names) if exists(spark, f"{n}/plan/_SUCCESS") and not exists(spark, f"{n}/done/_SUCCESS")), None)


def work_through(spark: SparkSession, base: str, plan: DataFrame, task: Callable) -> DataFrame:
    """Finish the unfinished plan below base, if there is one, or write this one and work through it: a row of DONE for each directory."""
    at = unfinished(spark, base)
    if at is None:
        at = f"{base}/{uuid.uuid4().hex}"
        plan.withColumn("plan", F.lit(at.rsplit("/", 1)[1])).write.parquet(f"{at}/plan")
    rows = spark.read.parquet(f"{at}/plan").select("plan", *KEY, "day", "dir", "paths", "files", "bytes")
    dealt = rows.repartition(spark.sparkContext.defaultParallelism * 4, "dir")  # so many tasks, however few bytes the plan has
    dealt.mapInPandas(task, DONE).write.mode("overwrite").parquet(f"{at}/done")
    return spark.read.schema(DONE).parquet(f"{at}/done")


def located(path: str):
    """The file system and the name there of a path as Spark gives it: its percent signs, spaces and letters are the name's own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(path, safe="/:@=,;+&$!'()*~") if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) else path)


def _escaped(value: str) -> str:
    """A value as a directory's name has it."""
    return re.sub("[\\x00-\\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def _day_table(store, names: list[str]):
    """The rows of some files in order of time, without the series; files that can't be read are passed over. None if there is none."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    kinds = {"timestamp": pa.timestamp("us", "UTC"), "string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in BARS_SCHEMA if f.name not in KEY]
    parts = []
    for name in names:
        try:
            with store.open_input_file(name) as f:
                t = pq.ParquetFile(f).read()
        except (OSError, ValueError):
            continue
        at = t.column("window_start")
        t = t.set_column(t.schema.get_field_index("window_start"), "window_start", at if at.type.tz else at.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))) if pa.types.is_timestamp(at.type) else t
        parts.append(pa.table({k: t.column(k).cast(kind) if k in t.column_names else pa.nulls(len(t), kind) for k, kind in fields}))
    if not parts:
        return None
    whole = pa.concat_tables(parts)
    k = whole.schema.get_field_index("source")
    return whole.set_column(k, "source", pc.fill_null(whole.column(k), "unknown")).sort_by("window_start")


def whole_day(dst: str | None, codec: str) -> Callable:
    """A task that makes one file of each directory: below dst, or in its place (dst None), where the files of the plan go."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                store, own = located(r.dir)
                names = [located(p)[1] for p in r.paths]
                to, into = (store, own) if dst is None else located("/".join([dst, *[f"{k}={_escaped(v)}" for k, v in zip((*KEY, "year", "month", "day"), (r.exchange, r.symbol, *r.day.strftime("%Y-%m-%d").split("-")), strict=True)]]))
                # two directories of one day (of other layouts) make two files
                mark = f"{into}/whole-{r.plan}-{uuid.uuid5(uuid.NAMESPACE_URL, r.dir).hex}.parquet"
                if to.get_file_info(mark).type == fs.FileType.NotFound:
                    table = _day_table(store, names)
                    if table is None:
                        continue
                    to.create_dir(into, recursive=True)
                    hidden = f"{into}/.{uuid.uuid4().hex}"
                    with to.open_output_stream(hidden) as f:
                        pq.write_table(table, f, compression=codec if codec in ("zstd", "snappy", "gzip") else "snappy")
                    to.move(hidden, mark)
                if dst is None:
                    for name in names:
                        if store.get_file_info(name).type != fs.FileType.NotFound:
                            store.delete_file(name)
                with to.open_input_file(mark) as f:
                    rows = pq.ParquetFile(f).metadata.num_rows
                after = [i for i in to.get_file_info(fs.FileSelector(into)) if i.base_name.endswith(".parquet") and not i.base_name.startswith(".")]
                out.append((r.plan, r.exchange, r.symbol, r.day, r.dir, r.files, r.bytes, len(after), sum(i.size for i in after), rows))
            yield _frame(out)

    return run


def deleted(parts: Iterator) -> Iterator:
    """A task that deletes the directories of a plan."""
    from pyarrow import fs

    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            store, name = located(r.dir)
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_dir(name)
            out.append((r.plan, r.exchange, r.symbol, r.day, r.dir, r.files, r.bytes, 0, 0, 0))
        yield _frame(out)


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=_NAMES)
