"""A store of tables with incremental checkpoints, and blocks of rows and columns that replay to a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..plans.tree import Relationship


class ReadOnlyError(PermissionError):
    """The store was opened for reading."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a temporary name, so readers never see half a file."""
    fs, at = _files(spark, path)
    _, tmp = _files(spark, path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(tmp, at):
        raise OSError(f"cannot write {path}")


class DataStore:
    """Tables by name, each with a key column. A checkpoint writes only columns changed since the last one.

    Tables are Parquet folders under ``directory``; checkpoints are listed in <name>.json files there. Each write makes
    a fresh folder, so a checkpoint under a name that was used before loses nothing that others, or it, refer to.
    """

    VERSION = 1

    def __init__(self, spark: SparkSession, directory: str, *, mode: str = "a"):
        if directory is None:
            raise NotADirectoryError("a store needs a directory")
        self.spark, self.directory, self.mode = spark, directory.rstrip("/"), mode
        self.tables: dict[str, DataFrame] = {}
        self.keys: dict[str, str] = {}
        self.saved: dict[str, dict[str, str]] = {}  # table -> column -> folder
        self.relationships: list[Relationship] = []

    def _write(self) -> None:
        if self.mode == "r":
            raise ReadOnlyError(self.directory)

    def set_data(self, name: str, df: DataFrame, key: str) -> None:
        self._write()
        self.tables[name], self.keys[name], self.saved[name] = df, key, {}

    def update(self, name: str, df: DataFrame) -> None:
        """Adds or replaces columns of a table by its key; these are written at the next checkpoint."""
        self._write()
        key = self.keys[name]
        new = [c for c in df.columns if c != key]
        self.tables[name] = self.tables[name].drop(*new).join(df, key, "left")
        for c in new:
            self.saved[name].pop(c, None)

    def __setitem__(self, name: tuple[str, str], column) -> None:
        self._write()
        table, c = name
        self.tables[table] = self.tables[table].withColumn(c, column)
        self.saved[table].pop(c, None)

    def get_dataframe(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        df = self.tables[name]
        return df if columns is None else df.select(self.keys[name], *columns)

    get_dataset = get_dataframe

    def add_relationship(self, r: str | Relationship) -> None:
        self.relationships.append(Relationship.parse(r) if isinstance(r, str) else r)

    def clone(self, *, mode: str | None = None) -> DataStore:
        out = DataStore(self.spark, self.directory, mode=mode or self.mode)
        out.tables, out.keys, out.saved, out.relationships = dict(self.tables), dict(self.keys), {k: dict(v) for k, v in self.saved.items()}, list(self.relationships)
        return out

    def make_checkpoint(self, name: str, *, overwrite: bool = True) -> None:
        self._write()
        path = f"{self.directory}/{name}.json"
        if not overwrite and read_text(self.spark, path) is not None:
            raise FileExistsError(path)
        for table, df in self.tables.items():
            key = self.keys[table]
            changed = [c for c in df.columns if c != key and c not in self.saved[table]]
            if changed or not self.saved[table]:
                folder = f"{name}-{uuid.uuid4().hex[:12]}"
                df.select(key, *changed).write.parquet(f"{self.directory}/{table}/{folder}")
                self.saved[table].update(dict.fromkeys(changed, folder))
                self.saved[table].setdefault("", folder)
        write_text(self.spark, path, json.dumps({"version": self.VERSION, "keys": self.keys, "columns": self.saved, "order": {t: df.columns for t, df in self.tables.items()}, "relationships": [str(r) for r in self.relationships]}, indent=1))

    def read_metadata(self, name: str) -> dict:
        text = read_text(self.spark, f"{self.directory}/{name}.json")
        if text is None:
            raise FileNotFoundError(f"{self.directory}/{name}.json")
        meta = json.loads(text)
        if meta.get("version") != self.VERSION:
            raise ValueError(f"version {meta.get('version')} is not known")
        return meta

    def restore_checkpoint(self, name: str) -> None:
        """Tables as they were: each column from the checkpoint that wrote it, joined by key."""
        meta = self.read_metadata(name)
        self.tables, self.keys, self.saved = {}, dict(meta["keys"]), {k: dict(v) for k, v in meta["columns"].items()}
        self.relationships = [Relationship.parse(r) for r in meta["relationships"]]
        for table, key in self.keys.items():
            by: dict[str, list[str]] = {}
            for c, at in self.saved[table].items():
                by.setdefault(at, []).extend([c] if c else [])
            df = None
            for at, columns in by.items():
                part = self.spark.read.parquet(f"{self.directory}/{table}/{at}").select(key, *columns)
                df = part if df is None else df.join(part, key, "left")
            self.tables[table] = df.select(*meta["order"][table])


class BlockTable:
    """A table kept as blocks: some append rows, some append columns. Reading replays them in order.

    Each block is a Parquet folder NNN.rows or NNN.cols under ``path``; a list in blocks.json says which are whole.
    """

    ROW = "__row"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def blocks(self) -> list[dict]:
        text = read_text(self.spark, f"{self.path}/blocks.json")
        return json.loads(text) if text else []

    def _add(self, df: DataFrame, kind: str, name: str | None, **more) -> None:
        held = self.blocks()
        folder = f"{len(held):03d}.{kind}"
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        write_text(self.spark, f"{self.path}/blocks.json", json.dumps([*held, {"folder": folder, "name": name or folder, "kind": kind, **more}], indent=1))

    def write(self, df: DataFrame, name: str | None = None) -> None:
        """Appends what is new in a table of all rows so far and more: new columns of the rows so far, then new rows.

        The table has a column __row. A write with both adds two blocks under one name.
        """
        now = self.read() if self.blocks() else None
        if now is None:
            self._add(df, "rows", name)
            return
        have = now.select(self.ROW)
        fresh = df.join(have, self.ROW, "left_anti")
        columns = [c for c in df.columns if c not in now.columns]
        grows = not fresh.isEmpty()
        if columns:
            self._add(df.join(have, self.ROW, "left_semi").select(self.ROW, *columns), "cols", name)
        if grows:
            self._add(fresh, "rows", name)

    def read(self, block: int | str | None = None) -> DataFrame:
        """The table as of a block (by number or name), or as it is."""
        out, held = None, self.blocks()
        for i, b in enumerate(held):
            part = self.spark.read.parquet(f"{self.path}/{PurePosixPath(b['folder'])}")
            if b["kind"] == "rows":
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            else:
                out = out.join(part, self.ROW, "left")
            if block == i or block == b["name"] and b["name"] not in [x["name"] for x in held[i + 1 :]]:
                return out
        if out is None or block is not None:
            raise FileNotFoundError(f"{self.path}: block {block}")
        return out



