"""Models on disk: a folder of Parquet tables with a manifest that is written last, and no code in it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark import log
from tidemark.operators.generate import Model

ARTIFACT_VERSION = "1.0"
MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, by whatever file system the path names."""
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def write_json(spark: SparkSession, path: str, data: Any) -> None:
    write_text(spark, path, json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


class Staged:
    """A folder that appears whole: written beside its place and renamed at the end, or not at all."""

    def __init__(self, spark: SparkSession, path: str, *, marker: str = MANIFEST, force: bool = False):
        self.spark, self.path, self.marker, self.force = spark, path.rstrip("/"), marker, force

    def __enter__(self) -> str:
        fs, target = _fs(self.spark, self.path)
        if fs.exists(target):
            empty = not fs.listStatus(target)
            ours = exists(self.spark, f"{self.path}/{self.marker}")
            if not empty and not (self.force and ours):
                raise ValueError(f"{self.path} exists" + ("" if ours else " and is not ours to replace"))
        self.aside = f"{self.path}.{uuid.uuid4().hex[:8]}"
        return self.aside

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            remove(self.spark, self.aside)
            return
        fs, target = _fs(self.spark, self.path)
        old = f"{self.aside}.old"
        held = fs.exists(target) and fs.rename(target, _fs(self.spark, old)[1])
        if not fs.rename(_fs(self.spark, self.aside)[1], target):
            if held:
                fs.rename(_fs(self.spark, old)[1], target)
            raise OSError(f"{self.path} could not be put in its place")
        if held:
            remove(self.spark, old)


def _digest(df: DataFrame) -> list[int]:
    return [int(x) for x in log.fingerprint(df).first()]


def describe(model: Model) -> dict[str, Any]:
    """Settings, and the rows of each table."""
    return {"settings": model.settings, "tables": {name: df.count() for name, df in sorted(model.items())}}


def markdown(description: Mapping[str, Any]) -> str:
    lines = ["# Model", "", "| Setting | Value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted(description["settings"].items()))]
    return "\n".join([*lines, "", "| Table | Rows |", "| --- | --- |", *(f"| {k} | {n} |" for k, n in description["tables"].items())]) + "\n"


def save(model: Model, path: str, *, training: DataFrame | None = None, force: bool = False) -> None:
    """Write a model; ``training`` is fingerprinted into the manifest."""
    spark = next(iter(model.values())).sparkSession
    with Staged(spark, path, force=force) as aside:
        for name, df in model.items():
            df.write.parquet(f"{aside}/{name}")
        stored = {name: _digest(spark.read.parquet(f"{aside}/{name}")) for name in model}
        kept = Model({name: spark.read.parquet(f"{aside}/{name}") for name in model}, model.settings)
        write_text(spark, f"{aside}/DESCRIPTION.md", markdown(describe(kept)))
        known = None if training is None else _digest(training.drop("metadata"))
        write_json(spark, f"{aside}/{MANIFEST}", {"artifact_version": ARTIFACT_VERSION, "settings": model.settings, "tables": stored, "training_fingerprint": known})


def load(spark: SparkSession, path: str) -> Model:
    """Read a model whose tables are as its manifest says."""
    manifest = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
    if manifest["artifact_version"].split(".")[0] != ARTIFACT_VERSION.split(".")[0]:
        raise ValueError(f"artifact version {manifest['artifact_version']} can't be read")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, df in tables.items():
        if _digest(df) != manifest["tables"][name]:
            raise ValueError(f"the table {name} is not the one that was saved")
    return Model(tables, manifest["settings"])
