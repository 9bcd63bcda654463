"""Consistent snapshots of a set of tables: data first, one manifest last.

A snapshot of an as-of date is a folder of Parquet tables under a name of its own and a manifest that lists, for
each table, its folder, its files with their sizes and a hash of its schema.  The manifest is written under a
temporary name and renamed when it is complete; before that the snapshot does not exist for a reader.  A run that is
killed while it writes leaves files that no manifest names, and the date's earlier snapshot stays what readers see.
Publishing a date again writes new folders and replaces the manifest, so a reader holds either the old or the new
set of files, never a mix.

Only file names and sizes pass the driver, no rows.  The listing is one row per file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import TABLE_NAMES, Tables, check_schema
from .normalize import normalized


class SnapshotError(RuntimeError):
    """The snapshot is missing or is not what its manifest says."""


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest_path(root: str, as_of: date) -> str:
    return f"{root}/_snapshots/{as_of.isoformat()}.json"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole text under ``path`` or nothing: written beside it and renamed."""
    files, at = _path(spark, path)
    files.mkdirs(at.getParent())
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options
    target = spark.sparkContext._gateway.new_array(options.Rename, 1)
    target[0] = options.Rename.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(beside), files.makeQualified(at), target)


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, at = _path(spark, path)
    if not files.exists(at):
        return None
    return "\n".join(r.value for r in spark.read.text(str(files.makeQualified(at))).collect())


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    files, at = _path(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in files.listStatus(at)
            if not s.getPath().getName().startswith(("_", "."))}


def schema_hash(df: DataFrame) -> str:
    """Names and types, in order."""
    return hashlib.sha256(json.dumps([(f.name, f.dataType.simpleString()) for f in df.schema]).encode()).hexdigest()


def publish(frames: dict[str, DataFrame], root: str, as_of: date) -> dict:
    """Write the frames as the snapshot of ``as_of`` and return its manifest."""
    spark = next(iter(frames.values())).sparkSession
    name = f"{as_of.isoformat()}-{uuid.uuid4().hex}"
    tables = {}
    for table, df in frames.items():
        folder = f"{root}/{name}/{table}"
        df.write.parquet(folder)
        tables[table] = {"folder": f"{name}/{table}", "files": _files(spark, folder), "schema": df.schema.jsonValue(), "hash": schema_hash(df)}
    manifest = {"as_of": as_of.isoformat(), "tables": tables}
    _write_text(spark, _manifest_path(root, as_of), json.dumps(manifest, sort_keys=True))
    return manifest


def snapshot(spark: SparkSession, root: str, as_of: date) -> dict[str, DataFrame]:
    """The frames of the published snapshot of ``as_of``: exactly the files of its manifest."""
    text = _read_text(spark, _manifest_path(root, as_of))
    if text is None:
        raise SnapshotError(f"no snapshot of {as_of} is published under {root}")
    out = {}
    for table, entry in json.loads(text)["tables"].items():
        there = _files(spark, f"{root}/{entry['folder']}")
        wrong = [f for f, size in entry["files"].items() if there.get(f) != size]
        if wrong:
            raise SnapshotError(f"{table}: {len(wrong)} of {len(entry['files'])} files are missing or have another size, as {wrong[0]}")
        schema = T.StructType.fromJson(entry["schema"])
        paths = [f"{root}/{entry['folder']}/{f}" for f in sorted(entry["files"])]
        df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        if schema_hash(df) != entry["hash"]:
            raise SnapshotError(f"{table}: its schema is not the one that was published")
        out[table] = df
    return out


def publish_tables(tables: Tables, root: str, as_of: date, ignore_case: bool = False) -> dict:
    """The 20 operational tables as the snapshot of ``as_of``; with ``ignore_case`` compared texts are stored in
    the reports' spelling, without trailing blanks (``normalize``)."""
    if ignore_case:
        tables = normalized(tables)
    return publish({n: getattr(tables, n) for n in TABLE_NAMES}, root, as_of)


def load_snapshot(spark: SparkSession, root: str, as_of: date) -> Tables:
    """The operational tables of the snapshot of ``as_of``, checked against their declarations."""
    frames = snapshot(spark, root, as_of)
    missing = [n for n in TABLE_NAMES if n not in frames]
    if missing:
        raise SnapshotError(f"the snapshot of {as_of} has no {', '.join(missing)}")
    return Tables(**{n: check_schema(frames[n], n) for n in TABLE_NAMES})
