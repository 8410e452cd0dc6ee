"""Exact top-k by inner product: branch-and-bound over vectors in vertical layout.

Vectors become whole numbers, floor(1024 * x), and are packed into blocks that hold, for each run of
`DIMS` dimensions, the components of all vectors of the block side by side, and the length of each
vector within that run. A query meets a block run by run, the run where the queries are longest first.
What the runs that are left can add is at most the sum of the products of the lengths there; candidates
whose score so far and this remainder stay below the k-th best score the task has are dropped, and the
rest is compacted before the next run. Queries are rows too: those with an id divisible by `EVERY`.
They meet all rows in passes of bounded blocks (`blocks.passes`).

Defined cases: a vector that is null, or holds a null, a component that is not finite, or one whose 1024-fold is not,
takes no part; a shorter vector counts as zero beyond its end, so an empty one scores 0; rows with a null
id are candidates, last among equal scores, and never queries; rows that repeat an id are rows of their
own: each is a candidate for the others and, as a query, gets a list of its own; scores beyond 64 bits
become the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach.llm.blocks import Best, blocks_of, id_arrays, merged, numbered, once, passes, stage_blocks

SCALE = 1024
DIMS = 8
ROWS = 4096  # most vectors of a block
QUERIES = 512
CELLS = 1 << 18  # most components of a block: 2 MB
EVERY = 100
EXACT = 2.0**52  # products of lengths below this: all sums are exact in doubles

BLOCK = "part long, k long, first long, ids array<long>, runs array<binary>, lengths binary"
FOUND = "part long, number long, at long, query_id long, vec_id long, score long"


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as whole numbers, offsets of the vectors in them, and which vectors take part."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)  # null: not a number
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * SCALE)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return flat, offsets, valid & (bad[offsets[1:]] == bad[offsets[:-1]])


def packed(rows: list[tuple]) -> tuple[list[bytes], bytes]:
    """Runs of dimensions, and lengths by run and vector, of (id, vector) rows."""
    runs = max(1, -(-max(len(v) for _, v in rows) // DIMS))
    table = np.zeros((len(rows), runs * DIMS))
    for i, (_, vector) in enumerate(rows):
        table[i, : len(vector)] = vector
    parts = np.ascontiguousarray(table.T).reshape(runs, DIMS, len(rows))
    lengths = np.sqrt((parts * parts).sum(axis=1)) * (1 + 1e-12)
    return [p.tobytes() for p in parts], lengths.tobytes()


def _block(part: int, k: int, first: int, rows: list[tuple]) -> pa.RecordBatch:
    runs, lengths = packed(rows)
    columns = [[part], [k], [first], [[i for i, _ in rows]], [runs], [lengths]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
    names = ["part", "k", "first", "ids", "runs", "lengths"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _pack(rows: Iterator[tuple], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task; `first` numbers the rows of all tasks apart."""
    part = TaskContext.get().partitionId()
    first = part << 33
    for k, block in enumerate(blocks_of(rows, lambda r: len(r[1]) + DIMS, CELLS, most)):
        yield _block(part, k, first, block)
        first += len(block)


def vertical(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Written table of blocks of all vectors that take part."""

    def read(batches) -> Iterator[tuple]:
        for batch in batches:
            flat, offsets, fine = whole(batch.column("v"))
            ids = batch.column("id").to_pylist()
            for i in np.flatnonzero(fine).tolist():
                yield ids[i], flat[offsets[i] : offsets[i + 1]]

    narrow = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return stage_blocks(narrow.mapInArrow(lambda b: _pack(read(b), ROWS), BLOCK))


class Block:
    """Vectors in vertical layout."""

    def __init__(self, runs, lengths: bytes, ids: pa.Array):
        self.ids, self.nulls = id_arrays(ids)
        n = len(self.ids)
        self.runs = [np.frombuffer(r.as_buffer()).reshape(DIMS, n) for r in runs]
        self.lengths = np.frombuffer(lengths).reshape(len(self.runs), n)
        with np.errstate(over="ignore"):
            self.longest = float(np.sqrt((self.lengths**2).sum(axis=0)).max(initial=0))

    def column(self, i: int) -> np.ndarray:
        return np.concatenate([r[:, i] for r in self.runs])


def query_blocks(blocks: DataFrame, every: int = EVERY) -> DataFrame:
    """Numbered blocks of the queries among the rows of `blocks`, with `rows`, their row numbers."""

    def pick(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, runs, lengths in zip(*(batch.column(c) for c in ("first", "ids", "runs", "lengths"))):
                block = Block(runs.values, lengths.as_buffer(), ids.values)
                chosen = np.flatnonzero(~block.nulls & (block.ids % every == 0)).tolist()
                if chosen:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([first.as_py() + i for i in chosen], pa.int64()),
                            pa.array([int(block.ids[i]) for i in chosen], pa.int64()),
                            pa.array([block.column(i).tobytes() for i in chosen], pa.binary()),
                        ],
                        names=["row", "id", "v"],
                    )

    def pack(batches) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row, i, v in zip(*(batch.column(c) for c in ("row", "id", "v"))):
                    yield (row.as_py(), i.as_py()), np.frombuffer(v.as_buffer())

        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks_of(rows(), lambda r: len(r[1]) + DIMS, CELLS, QUERIES)):
            made = _block(part, k, 0, [(i, v) for (_, i), v in block])
            yield made.append_column("rows", pa.array([[row for (row, _), _ in block]], pa.list_(pa.int64())))

    narrow = blocks.select("first", "ids", "runs", "lengths")
    chosen = stage_blocks(narrow.mapInArrow(pick, "row long, id long, v binary"))
    made = stage_blocks(chosen.hint("rebalance").mapInArrow(pack, BLOCK + ", rows array<long>"))
    return numbered(made.select(
        "part", "k", F.col("ids").alias("q_ids"), F.col("runs").alias("q_runs"), F.col("lengths").alias("q_lengths"), "rows"
    ))


def meet(q: Block, rows: np.ndarray, c: Block, first: int, best: list[Best]) -> None:
    """Put the candidates of one block into the lists of the queries of another, rows but their own."""
    n = len(c.ids)
    if q.longest * c.longest >= EXACT:
        return _meet_large(q, rows, c, first, best)
    runs = min(len(q.runs), len(c.runs))
    order = np.argsort(-(q.lengths[:runs] ** 2).sum(axis=1), kind="stable").tolist()
    so_far = q.runs[order[0]].T @ c.runs[order[0]]
    bounds = so_far + q.lengths[order[1:]].T @ c.lengths[order[1:]]
    for i, list_ in enumerate(best):
        least = list_.least
        at = None if least is None else np.flatnonzero(bounds[i] >= least - 1)
        score, bound = (so_far[i], bounds[i]) if at is None else (so_far[i, at], bounds[i, at])
        for run in order[1:]:
            if not len(score):
                break
            there, length = c.runs[run], c.lengths[run]
            if at is not None:
                there, length = there[:, at], length[at]
            more = q.runs[run][:, i] @ there
            score = score + more
            if least is None:
                continue
            bound = bound + more - q.lengths[run, i] * length
            alive = np.flatnonzero(bound >= least - 1)
            if len(alive) < len(score):
                at, score, bound = at[alive], score[alive], bound[alive]
        at = np.arange(n) if at is None else at
        other = at != rows[i] - first
        list_.add(score[other].astype(np.int64), c.ids[at[other]], c.nulls[at[other]])


def _meet_large(q: Block, rows: np.ndarray, c: Block, first: int, best: list[Best]) -> None:
    """Components so large that doubles may round: whole numbers without a limit."""
    low, high = -(2**63), 2**63 - 1
    columns = [[int(x) for x in c.column(j)] for j in range(len(c.ids))]
    for i, list_ in enumerate(best):
        own = [int(x) for x in q.column(i)]
        keep = np.array([j for j in range(len(columns)) if j != rows[i] - first], np.int64)
        scores = [min(max(sum(a * b for a, b in zip(own, columns[j])), low), high) for j in keep.tolist()]
        list_.add(np.array(scores, np.int64), c.ids[keep], c.nulls[keep])


def top(rows: DataFrame, k: int = 10, every: int = EVERY, held: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` best rows of each query."""
    blocks = vertical(rows)
    queries = query_blocks(blocks, every)

    def search(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict = {}  # block of queries: its vectors, row numbers and lists
        held_block: dict = {}
        names = ("first", "ids", "runs", "lengths", "number", "q_ids", "q_runs", "q_lengths", "rows")
        for batch in batches:
            for first, ids, runs, lengths, number, q_ids, q_runs, q_lengths, q_rows in zip(
                *(batch.column(c) for c in names)
            ):
                first, number = first.as_py(), number.as_py()
                block = once(held_block, first, lambda: Block(runs.values, lengths.as_buffer(), ids.values))
                if number not in seen:
                    q = Block(q_runs.values, q_lengths.as_buffer(), q_ids.values)
                    seen[number] = (q, q_rows.values.to_numpy(), [Best(k) for _ in range(len(q.ids))])
                q, own, best = seen[number]
                meet(q, own, block, first, best)
        for number, (q, own, best) in seen.items():
            counts = [len(b.scores) for b in best]
            of = np.repeat(np.arange(len(best)), counts)
            scores, found, nulls = (np.concatenate([getattr(b, x) for b in best]) for x in ("scores", "ids", "nulls"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(of), part, np.int64)), pa.array(np.full(len(of), number, np.int64)),
                    pa.array(of), pa.array(q.ids[of]), pa.array(found, mask=nulls), pa.array(scores),
                ],
                names=["part", "number", "at", "query_id", "vec_id", "score"],
            )

    narrow = blocks.select("first", "ids", "runs", "lengths")
    lists = passes(narrow, queries, search, FOUND, **({"held": held} if held else {}))
    best = merged(lists, ["number", "at", "query_id"], "vec_id", k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_topk(spark, folder: str) -> DataFrame:
    """The ten best rows of every query among the embeddings."""
    return top(spark.read.parquet(f"{folder}/embeddings.parquet"))


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
