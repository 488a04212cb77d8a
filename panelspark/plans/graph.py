"""A graph of stages kept as tables, each named by what it depends on.

A source is named by what it holds: files by schema, paths, sizes and times, a frame by schema and contents. A stage is named by its settings and the names of its
inputs, so a changed input gives new names to all that lies below it and to nothing else. A value (a choice, a check: small and plain) is named by what it came out as, so where a new
input leads to the same choice, what follows from the choice is read, not made again. Stages are written to the root's folder and read from there: lineage ends at each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Materializer, jsonable


def _tag(x: Any) -> str:
    return hashlib.sha256(json.dumps(jsonable(x), sort_keys=True).encode()).hexdigest()[:16]


def files_tag(spark: SparkSession, path: str) -> str:
    """Of the files under a path: how many, how large, and a mix of each one's path, size and time. Spark lists them; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    got = listed.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mix")).first()
    return _tag([path, *got])


def contents_tag(df: DataFrame) -> str:
    """Of a frame's rows, in any order and with their counts: two sums of 64-bit hashes by different seeds."""
    plain = [F.col(f"`{c}`") for c in df.columns]
    hashes = [F.sum(F.xxhash64(F.lit(seed), *plain).cast("decimal(38,0)")) for seed in (1, 2)]
    return _tag([df.schema.json(), *df.agg(F.count(F.lit(1)), *hashes).first()])


@dataclass
class Node:
    kind: str
    inputs: tuple[str, ...] = ()
    settings: Any = None
    make: Callable | None = None
    tag: str | None = None
    held: list = field(default_factory=list, repr=False)


class Graph:
    """Nodes by name. ``ran`` lists the stages and values made now, as opposed to read."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.keep = spark, Materializer(spark, root)
        self.nodes: dict[str, Node] = {}
        self.ran: list[str] = []

    def _add(self, name: str, node: Node) -> str:
        unknown = [i for i in node.inputs if i not in self.nodes]
        if unknown:
            raise ValueError(f"{name}: unknown inputs {unknown}")
        self.nodes[name] = node
        return name

    def files(self, name: str, path: str, read: Callable[[SparkSession, str], DataFrame] | None = None, settings: Any = None) -> str:
        """A source in files; ``read`` makes its frame, ``settings`` tell what read depends on besides the path."""
        return self._add(name, Node("files", settings=[path, settings], make=lambda: (read or (lambda s, p: s.read.parquet(p)))(self.spark, path)))

    def frame(self, name: str, df: DataFrame) -> str:
        """A source given as a frame. Its rows are read once for its name."""
        return self._add(name, Node("frame", make=lambda: df))

    def stage(self, name: str, make: Callable[..., DataFrame], *inputs: str, settings: Any = None) -> str:
        """make(*inputs): frames of the stages and sources, plain values of the values named."""
        return self._add(name, Node("stage", inputs, settings, make))

    def value(self, name: str, make: Callable[..., Any], *inputs: str, settings: Any = None) -> str:
        """make(*inputs) gives something plain: numbers, text, lists and dicts with text keys."""
        return self._add(name, Node("value", inputs, settings, make))

    def _recipe(self, name: str) -> str:
        node = self.nodes[name]
        return _tag([name, node.kind, node.settings, [self.tag(i) for i in node.inputs]])

    def tag(self, name: str) -> str:
        """What names a node's result."""
        node = self.nodes[name]
        if node.tag is None:
            if node.kind == "files":
                node.tag = _tag([files_tag(self.spark, node.settings[0]), node.settings[1]])
            elif node.kind == "frame":
                node.tag = contents_tag(node.make())
            elif node.kind == "stage":
                node.tag = self._recipe(name)
            else:
                node.tag = _tag(self.get(name))
        return node.tag

    def get(self, name: str) -> Any:
        """A stage's or source's frame, or a value; made if it is not there under its name."""
        node = self.nodes[name]
        if node.held:
            return node.held[0]
        if node.kind in ("files", "frame"):
            node.held.append(node.make())
        elif node.kind == "stage":
            node.held.append(self.keep.get(name, lambda: self._made(name), self.tag(name)))
        else:
            path = self.keep.path(name, self._recipe(name))
            if not self.keep._exists(f"{path}/_SUCCESS"):
                text = json.dumps(jsonable(self._made(name)))
                self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
            node.held.append(json.loads(self.spark.read.text(path, wholetext=True).first()[0]))
        return node.held[0]

    def _made(self, name: str) -> Any:
        node = self.nodes[name]
        self.ran.append(name)
        return node.make(*[self.get(i) for i in node.inputs])

    def lineage(self) -> list[dict]:
        """What has been named so far: node, kind, tag, inputs."""
        return [{"name": k, "kind": n.kind, "tag": n.tag, "inputs": list(n.inputs)} for k, n in self.nodes.items() if n.tag is not None]
