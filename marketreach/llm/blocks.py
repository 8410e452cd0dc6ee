"""A stated query set against all rows, in blocks: numbered blocks, bounded passes, merged top-k lists.

Rows and queries are packed into blocks of a bounded size and written. A pass broadcasts at most `HELD`
blocks of queries, each of at most the size its packer allows, and reads the blocks of rows once; tasks
keep the best of each query of the pass. More queries mean more passes, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketreach.session import stage

HELD = 16  # blocks of queries in a pass
SLICES = 32  # parts in which the lists of one query are merged first
BATCH = "8m"  # most bytes that reach a Python worker at a time, beyond one row
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A writer looks at the size of a row group or page after 100 rows, which may be 100 blocks: it looks after one. A
#: reader takes up to 4096 rows of a row group at once, so this bounds what it holds too. A dictionary
#: would be begun anew in every row group, and given up, as the terms and bytes of blocks are hardly ever equal.
ROW_GROUPS = {
    "parquet.block.size": str(1 << 23),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}


def stage_blocks(df: DataFrame) -> DataFrame:
    """`stage`, with Arrow batches and row groups bounded by bytes: a row may be a block."""
    conf = df.sparkSession.conf
    before = conf.get(LIMIT, None)
    conf.set(LIMIT, BATCH)
    try:
        return stage(df, **ROW_GROUPS)
    finally:
        conf.set(LIMIT, before) if before else conf.unset(LIMIT)


def numbered(blocks: DataFrame) -> DataFrame:
    """Written table of blocks with `number` (0 to their count - 1) for `part` (task) and `k` (block of the task)."""
    sizes = blocks.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    first = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return stage(blocks.join(first, "part").withColumn("number", F.col("before") + F.col("k")).drop("part", "k", "before"))


def passes(rows: DataFrame, queries: DataFrame, function: Callable, schema: str, held: int = HELD) -> DataFrame:
    """`function`, a mapInArrow function, over every block of `rows` beside every block of numbered `queries`."""
    found = []
    for low in range(0, max(queries.count(), 1), held):
        part = queries.filter(F.col("number").between(low, low + held - 1))
        found.append(stage_blocks(rows.crossJoin(F.broadcast(part)).mapInArrow(function, schema)))
    return reduce(DataFrame.unionByName, found)


def merged(lists: DataFrame, query: list[str], ident: str, k: int) -> DataFrame:
    """The `k` rows of each query with the highest score and then the smallest `ident` (null last), with rank.

    `part` names the task a row is from. Lists are cut to `k` before and after they meet in one of
    `SLICES` parts of their query, so no task gets all lists of a query.
    """
    order = [F.desc("score"), F.asc_nulls_last(ident)]
    near = Window.partitionBy(*query, "slice").orderBy(*order)
    whole = Window.partitionBy(*query).orderBy(*order)
    sliced = lists.withColumn("slice", F.pmod(F.col("part"), F.lit(SLICES)))
    some = sliced.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


class Best:
    """The best `k` of one query that a task has met: highest score, then smallest id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.nulls = np.zeros(0, bool)

    @property
    def least(self) -> int | None:
        """The score that a further row must reach, if there is one yet."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if self.least is not None:
            at = np.flatnonzero(scores >= self.least)
            scores, ids, nulls = scores[at], ids[at], nulls[at]
        if len(scores) > self.k:
            at = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids, nulls = scores[at], ids[at], nulls[at]
        if not len(scores):
            return
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((ids, nulls, ~scores))[: self.k]  # ~ turns the order round and does not overflow
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def id_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null) and null marks of an Arrow array of longs."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def once(held: dict, key, make: Callable):
    """`make()`, kept until another key is asked for."""
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def blocks_of(rows: Iterator, cost: Callable, limit: int, most: int) -> Iterator[list]:
    """Lists of at most `most` rows whose costs add up to about `limit`; one dearer row stands alone."""
    part, size = [], 0
    for row in rows:
        own = cost(row)
        if part and (size + own > limit or len(part) >= most):
            yield part
            part, size = [], 0
        part.append(row)
        size += own
    if part:
        yield part
