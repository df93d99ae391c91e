"""Nodes as folders: one Parquet table for each set of dims, and a list of them."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..plans.tree import Frame, Node
from .store import read_text, write_text


def write_node(node: Node, path: str, *, partition_by: str | None = None) -> None:
    """Writes all frames; with partition_by each value of that dim (or column) gets a folder of its own, for pruning."""
    path, spark = path.rstrip("/"), node.frames[0].df.sparkSession
    held = []
    for i, f in enumerate(node.frames):
        writer = f.df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by in f.df.columns else writer).parquet(f"{path}/frame-{i}")
        held.append({"dims": list(f.dims), "columns": f.df.columns})
    meta = {"name": node.name, "frames": held, "order": node.order, "unique": node.unique, "dense": node.dense, "categories": {k: list(v) for k, v in node.categories.items()}}
    write_text(spark, f"{path}/node.json", json.dumps(meta, indent=1))


def read_node(spark: SparkSession, path: str) -> Node:
    """The node that ``write_node`` wrote, with what was known of its keys."""
    path = path.rstrip("/")
    text = read_text(spark, f"{path}/node.json")
    if text is None:
        raise FileNotFoundError(f"{path}/node.json")
    meta = json.loads(text)
    frames = [Frame(tuple(f["dims"]), spark.read.parquet(f"{path}/frame-{i}").select(*f["columns"])) for i, f in enumerate(meta["frames"])]
    return Node(meta["name"], frames, order=meta["order"], unique=meta["unique"], dense=meta["dense"], categories={k: tuple(v) for k, v in meta["categories"].items()})


def share(node: Node, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Node:
    """Keeps the node's frames on the executors for repeated flows; ``release`` lets them go."""
    for f in node.frames:
        f.df.persist(level)
    return node


def release(node: Node) -> None:
    for f in node.frames:
        f.df.unpersist()
