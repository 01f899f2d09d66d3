"""Fitted models and runs on shared storage: a folder per version with tables, ML parts, and a manifest that is written last.

A version without its manifest does not exist for readers, so a job that dies while saving leaves the versions before it in force. Tables
are read lazily. Only classes of this package are made from a manifest.
"""

from __future__ import annotations

import dataclasses
import importlib
import json
from typing import Any

import numpy as np
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = "starloom"
FORMAT = 1


class _Writer:
    def __init__(self, folder: str):
        self.folder, self.count = folder, 0

    def _place(self, kind: str) -> str:
        self.count += 1
        return f"{kind}-{self.count:04d}"

    def plain(self, value: Any) -> Any:
        """``value`` as JSON; tables and ML parts are written, and named in it."""
        if value is None or isinstance(value, (bool, int, str)):
            return value
        if isinstance(value, (float, np.floating)):
            return float(value)
        if isinstance(value, np.integer):
            return int(value)
        if isinstance(value, list):
            return [self.plain(v) for v in value]
        if isinstance(value, tuple):
            return {"tuple": [self.plain(v) for v in value]}
        if isinstance(value, dict):
            return {"dict": [[self.plain(k), self.plain(v)] for k, v in value.items()]}
        if isinstance(value, np.ndarray):
            return {"array": value.tolist(), "dtype": str(value.dtype)}
        if isinstance(value, DataFrame):
            place = self._place("table")
            value.write.parquet(f"{self.folder}/{place}")
            return {"table": place}
        if isinstance(value, MLWritable):
            place = self._place("part")
            value.write().save(f"{self.folder}/{place}")
            return {"part": place}
        kind = type(value)
        if kind.__module__.split(".")[0] != PACKAGE:
            raise TypeError(f"cannot save a {kind.__module__}.{kind.__qualname__}")
        state = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)} if dataclasses.is_dataclass(value) else vars(value)
        return {"object": f"{kind.__module__}:{kind.__qualname__}", "state": {k: self.plain(v) for k, v in state.items()}}


def _read(spark: SparkSession, folder: str, value: Any) -> Any:
    if isinstance(value, list):
        return [_read(spark, folder, v) for v in value]
    if not isinstance(value, dict):
        return value
    if "tuple" in value:
        return tuple(_read(spark, folder, value["tuple"]))
    if "dict" in value:
        return {_read(spark, folder, k): _read(spark, folder, v) for k, v in value["dict"]}
    if "array" in value:
        return np.array(value["array"], value["dtype"])
    if "table" in value:
        return spark.read.parquet(f"{folder}/{value['table']}")
    if "part" in value:
        return DefaultParamsReader.loadParamsInstance(f"{folder}/{value['part']}", spark)
    module, name = value["object"].split(":")
    if module.split(".")[0] != PACKAGE:
        raise ValueError(f"not a class of this package: {value['object']}")
    kind = getattr(importlib.import_module(module), name)
    out = object.__new__(kind)
    for key, part in value["state"].items():
        object.__setattr__(out, key, _read(spark, folder, part))
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions below ``path``, oldest first."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return []
    found = []
    for status in files.listStatus(jvm_path):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "manifest/_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def save(model: Any, path: str, spark: SparkSession | None = None) -> int:
    """Write a fitted model or run as the next version below ``path``; its number."""
    spark = spark or SparkSession.getActiveSession()
    version = max(versions(spark, path), default=0) + 1
    folder = f"{path.rstrip('/')}/v{version}"
    while True:  # a folder without a manifest is left from a save that died
        try:
            content = _Writer(folder).plain(model)
            break
        except Exception as error:
            if "PATH_ALREADY_EXISTS" not in str(error) and "already exists" not in str(error):
                raise
            version += 1
            folder = f"{path.rstrip('/')}/v{version}"
    manifest = json.dumps({"format": FORMAT, "model": content})
    spark.range(1).select(F.lit(manifest).alias("value")).coalesce(1).write.text(f"{folder}/manifest")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Any:
    """The model or run saved below ``path``, by default its latest complete version."""
    known = versions(spark, path)
    if version is None and not known:
        raise FileNotFoundError(f"no saved version below {path}")
    if version is not None and version not in known:
        raise FileNotFoundError(f"no complete version {version} below {path}")
    folder = f"{path.rstrip('/')}/v{known[-1] if version is None else version}"
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifest").collect()))
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']} of {folder} is not known")
    return _read(spark, folder, manifest["model"])
