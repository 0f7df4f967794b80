"""Shards of a read-only side, written to the shared folder and read by the workers one at a time.

A side that every row of a large table has to pass (an index, a set of evaluation texts) is cut
into shards of bounded size. Each shard is a folder of Parquet files; a worker reads it when
it needs it and keeps the last few, so nothing is sent with the plan, nothing is built anew
for each task and the large table is neither copied nor shuffled for the shards' sake.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import stage_root

KEPT = 2
_cache: OrderedDict[tuple[str, int], object] = OrderedDict()


def store(side: DataFrame, name: str) -> str:
    """Writes ``side(shard int, ...)`` by shard; returns the folder, with its file system."""
    spark = side.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stage_root(spark).rstrip('/')}/hopweave/{uuid.uuid4().hex}-{name}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    side.write.partitionBy("shard").parquet(full)
    return full


def rows(folder: str, shard: int) -> list[dict]:
    """The rows of one shard; none where the shard is empty."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    local = re.match(r"file:/+", folder)
    system, path = (fs.LocalFileSystem(), "/" + folder[local.end() :]) if local else fs.FileSystem.from_uri(folder)
    path = f"{path}/shard={shard}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    return ds.dataset(path, filesystem=system, format="parquet").to_table().to_pylist()


def load(folder: str, shard: int, build: Callable[[list[dict]], object], keep: int = KEPT) -> object:
    """``build(rows)`` of a shard, kept by the worker process for its next tasks."""
    key = (folder, shard)
    if key in _cache:
        _cache.move_to_end(key)
    else:
        while len(_cache) >= keep:
            _cache.popitem(last=False)
        _cache[key] = build(rows(folder, shard))
    return _cache[key]
