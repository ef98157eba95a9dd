"""Model folders: versions of a fitted model, each with tables and a manifest."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT = 1
MANIFEST = "version string, written timestamp, manifest string"


def save(path: str, kind: str, about: dict, tables: dict[str, DataFrame], mark: str | None = None) -> str:
    """Write a new version below ``path`` and return its name.

    The manifest comes last and is what makes a version visible, so readers never meet half a
    model. ``mark`` names the state of the data the model was fitted on.
    """
    spark = SparkSession.active()
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{path}/versions/{version}/{name}")
    libraries = {"pyspark": pyspark.__version__, "numpy": np.__version__}
    manifest = {"format": FORMAT, "kind": kind, "mark": mark, "libraries": libraries, "tables": sorted(tables), **about}
    row = spark.createDataFrame([(version, json.dumps(manifest))], "version string, manifest string")
    row.select("version", F.current_timestamp().alias("written"), "manifest").coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version


def manifest(path: str, kind: str, mark: str | None = None, version: str | None = None) -> tuple[str, dict]:
    """The newest version (or the named one) and its manifest.

    Another kind, another format or, where ``mark`` is given, another state of the data is refused.
    """
    rows = SparkSession.active().read.schema(MANIFEST).json(f"{path}/manifests")
    rows = rows.where(F.col("version") == version) if version else rows
    newest = rows.agg(F.max_by(F.struct("version", "manifest"), F.struct("written", "version")).alias("m")).first()["m"]
    if newest is None:
        raise FileNotFoundError(f"no model version {version or ''} in {path}")
    found = json.loads(newest["manifest"])
    if found["format"] != FORMAT or found["kind"] != kind:
        raise ValueError(f"{path} holds {found['kind']} in format {found['format']}, not {kind} in format {FORMAT}")
    if mark is not None and found["mark"] != mark:
        raise ValueError(f"{path} was fitted on {found['mark']}, not on {mark}")
    return newest["version"], found


def table(path: str, version: str, name: str) -> DataFrame:
    return SparkSession.active().read.parquet(f"{path}/versions/{version}/{name}")
