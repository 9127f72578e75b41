"""Searches for a set of things of any size: the set goes to the tasks in blocks of bounded size, one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from skein.session import checkpoint


def in_passes(spark: SparkSession, blocks: Iterator[Any], search: Callable[[Any], DataFrame]) -> DataFrame:
    """What ``search`` finds for each broadcast block, all together; at least one block is needed.

    One block is with the driver and the tasks at a time: while another follows, a block's finds are written to the
    checkpoint folder, and the block is dropped before the next one is read. A single block costs no such write.
    """
    found, block = None, next(blocks)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        part = search(shared)
        block = next(blocks, None)
        if block is not None:
            part = checkpoint(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found
