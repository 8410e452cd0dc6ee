"""Ranked lexical search: an inverted index in blocks, read term at a time with limited accumulators.

The index holds all documents with a term. A block holds those of about `SLICE` bytes of text: their
lengths, the block's terms, and per term its documents and occurrences. Items meet the blocks in passes
of bounded blocks of items (`blocks.passes`). Within a block an item's terms are read rarest first, by
their document frequency in the whole table. Each term adds to the accumulators of its documents; when
all that the remaining terms can add is less than the k-th best score so far, of this block or of
earlier ones, no accumulator is created any more, and those that exist are updated exactly to the end.

Defined cases: a null text has no term; documents without a term are not ranked and not counted; items
without a term, or whose terms no document holds, have no rows; items with a null id are items; rows that
repeat an item_id, or a doc_id, are rows of their own; a null doc_id comes last among equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach.llm.blocks import Best, blocks_of, id_arrays, merged, numbered, once, passes, stage_blocks
from marketreach.session import stage

SLICE = 4_000_000  # bytes of text cut into terms at a time
DOCS = 1 << 20  # most documents of a block
ITEM_TERMS = 1 << 16  # terms of a block of items
ITEM_BYTES = 1 << 21
ITEMS = 512
#: Letters A-Z in lower case; every other ASCII sign but digits and letters becomes a blank.
TABLE = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)
BLANK = 0x20

INDEX = "ids array<long>, sizes binary, n_docs long, n_terms long, terms array<binary>, dfs array<long>, docs binary, tfs binary"
FOUND = "part long, number long, at long, item_id long, doc_id long, score long"


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, dictionary-encoded, and the text that each is from."""
    line = b" ".join(texts).translate(TABLE)
    signs = np.frombuffer(line, np.uint8)
    inside = signs != BLANK
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    data = pa.py_buffer(signs[inside].tobytes())
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), data])
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return terms.dictionary_encode(), np.searchsorted(first, starts, "right") - 1


def slices_of(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a text, cut before a sign that is in no term."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and TABLE[text[cut]] != BLANK:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Postings:
    """Occurrences of the terms of some documents."""

    def __init__(self, texts: list[bytes], limit: int = SLICE):
        n = len(texts)
        self.sizes = np.zeros(n, np.int64)
        parts = []
        for chunk in blocks_of(
            ((i, t) for i, text in enumerate(texts) for t in slices_of(text, limit)), lambda x: len(x[1]), limit, 1 << 62
        ):
            found, of = terms_of([t for _, t in chunk])
            docs = np.array([i for i, _ in chunk])[of]
            self.sizes += np.bincount(docs, minlength=n)
            key, counts = np.unique(found.indices.to_numpy().astype(np.int64) * n + docs, return_counts=True)
            parts.append((found.dictionary, key, counts))
        self.terms, key, counts = parts[0]
        if len(parts) > 1:
            every = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            code = every.indices.to_numpy().astype(np.int64)
            first = np.cumsum([0] + [len(p[0]) for p in parts])
            key = np.concatenate([code[f + p[1] // n] * n + p[1] % n for f, p in zip(first, parts)])
            key, of = np.unique(key, return_inverse=True)
            counts = np.zeros(len(key), np.int64)
            np.add.at(counts, of, np.concatenate([p[2] for p in parts]))
            self.terms = every.dictionary
        self.docs = (key % n).astype(np.int32)
        self.dfs = np.bincount(key // n, minlength=len(self.terms))
        self.tfs = counts.astype(np.int32)  # a text has less than 2^31 bytes


def index(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table of blocks (`INDEX`) of every document with a term."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                texts = batch.column("t").cast(pa.binary())
                for i, t in zip(batch.column("id").to_pylist(), texts):
                    yield i, t.as_py() or b""

        for block in blocks_of(rows(), lambda r: len(r[1]) + 16, SLICE, DOCS):
            found = Postings([t for _, t in block])
            if not len(found.terms):
                continue
            columns = [
                [[i for i, _ in block]], [found.sizes.tobytes()], [int((found.sizes > 0).sum())], [int(found.sizes.sum())],
                None, [found.dfs], [found.docs.tobytes()], [found.tfs.tobytes()],
            ]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            arrays = [None if c is None else pa.array(c, t) for c, t in zip(columns, kinds)]
            arrays[4] = pa.ListArray.from_arrays([0, len(found.terms)], found.terms.cast(pa.binary()))
            names = ["ids", "sizes", "n_docs", "n_terms", "terms", "dfs", "docs", "tfs"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return stage_blocks(narrow.mapInArrow(run, INDEX))


def item_terms(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """Written table (row, item_id, term): the distinct terms of each item; `row` tells items apart."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").cast(pa.binary())):
                found = Postings([t.as_py() or b""]).terms.cast(pa.binary())
                rows, ids = np.full(len(found), row), pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, found], names=["row", "item_id", "term"])
                row += 1

    narrow = items.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return stage(narrow.mapInArrow(run, "row long, item_id long, term binary"))


def weighed(terms: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """`terms` with df, the documents that hold the term, and weight; terms that no document holds go."""
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p"))
    wanted = terms.select("term").distinct()
    some = pairs.select(F.col("p.terms").alias("term"), F.col("p.dfs").alias("n")).join(wanted, "term", "left_semi")
    dfs = some.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")))
    return terms.join(dfs, "term").withColumn("weight", weight.cast("long"))


def item_blocks(terms: DataFrame) -> DataFrame:
    """Numbered blocks of items: their ids, and their terms, rarest first, with weights."""
    term = F.struct("df", "term", "weight")
    rows = terms.groupBy("row", "item_id").agg(F.array_sort(F.collect_list(term)).alias("terms"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        def items():
            for batch in batches:
                yield from zip(batch.column("item_id").to_pylist(), batch.column("terms").to_pylist(), batch.column("weights").to_pylist())

        cost = lambda r: sum(map(len, r[1])) + 32 * len(r[1])
        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks_of(items(), cost, ITEM_BYTES, ITEMS)):
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.binary())), pa.list_(pa.list_(pa.int64()))]
            columns = [[part], [k], *([[r[c] for r in block]] for c in range(3))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "k", "item_ids", "words", "weights"]
            )

    schema = "part long, k long, item_ids array<long>, words array<array<binary>>, weights array<array<long>>"
    narrow = rows.select("item_id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights"))
    return numbered(stage_blocks(narrow.hint("rebalance").mapInArrow(run, schema)))


class Block:
    """One block of the index, with what a document's length does to its scores."""

    def __init__(self, ids: pa.Array, sizes: bytes, terms: pa.Array, dfs: np.ndarray, docs: bytes, tfs: bytes, n: int, total: int):
        self.ids, self.nulls = id_arrays(ids)
        self.terms = terms
        self.first = np.concatenate(([0], np.cumsum(dfs)))
        self.docs, self.tfs = np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int32)
        self.norm = 8 * (10 + 90 * np.frombuffer(sizes, np.int64) * n // total)
        self.held: dict[int, tuple] = {}

    def term(self, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of a term, what an occurrence of weight 1 adds to each, and the most of that."""
        if at not in self.held:
            span = slice(self.first[at], self.first[at + 1])
            docs, tf = self.docs[span], self.tfs[span].astype(np.int64)
            gain = 1_000_000_000 * tf // (1000 * tf + self.norm[docs])
            self.held[at] = docs, gain, int(gain.max())
        return self.held[at]


def rank(block: Block, places: list[int], weights: list[int], best: Best, scores: np.ndarray, known: np.ndarray) -> int:
    """Put the documents of a block into the list of one item; `scores` and `known` are blank work space.

    `places` are those of the item's terms, rarest first. Returns the number of accumulators created.
    """
    found = [(*block.term(p), w) for p, w in zip(places, weights)]
    rest = sum(most * w for _, _, most, w in found)
    touched: list[np.ndarray] = []
    highest, creating = 0, True
    for docs, gain, most, weight in found:
        if creating:
            least = best.least or 0
            if rest < highest and sum(map(len, touched)) >= best.k:
                partial = scores[np.concatenate(touched)]
                least = max(least, int(np.partition(partial, -best.k)[-best.k]))
            creating = rest >= least
        if creating:
            touched.append(docs[~known[docs]])
            known[touched[-1]] = True
        else:
            old = known[docs]
            docs, gain = docs[old], gain[old]
        scores[docs] += weight * gain
        highest = max(highest, int(scores[docs].max(initial=0)))
        rest -= most * weight
    every = np.concatenate(touched) if touched else np.zeros(0, np.int64)
    good = every[scores[every] > 0]
    best.add(scores[good], block.ids[good], block.nulls[good])
    scores[every], known[every] = 0, False
    return len(every)


def search(items: DataFrame, docs: DataFrame, k: int = 10, blocks: DataFrame | None = None, held: int | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents of each item.

    `blocks` may be an index of `docs` made before.
    """
    blocks = index(docs) if blocks is None else blocks
    sums = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = (int(x or 0) for x in sums)
    queries = item_blocks(weighed(item_terms(items), blocks, n))

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        lists: dict = {}  # block of items: their ids and lists
        held_block: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                key = row["at"].as_py()
                block = once(held_block, key, lambda: Block(
                    row["ids"].values, row["sizes"].as_buffer(), row["terms"].values, row["dfs"].values.to_numpy(),
                    row["docs"].as_buffer(), row["tfs"].as_buffer(), n, total,
                ))
                number = row["number"].as_py()
                words, weights = row["words"].values, row["weights"].as_py()
                best = lists.setdefault(number, (row["item_ids"].values, [Best(k) for _ in weights]))[1]
                spans = words.offsets.to_pylist()
                place = pc.index_in(words.values, value_set=block.terms).fill_null(-1).to_pylist()
                scores, known = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), bool)
                for a, b, own, list_ in zip(spans, spans[1:], weights, best):
                    there = [(p, w) for p, w in zip(place[a:b], own) if p >= 0]
                    rank(block, [p for p, _ in there], [w for _, w in there], list_, scores, known)
        for number, (item_ids, best) in lists.items():
            of = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
            scores, found, nulls = (np.concatenate([getattr(b, x) for b in best]) for x in ("scores", "ids", "nulls"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(of), part, np.int64)), pa.array(np.full(len(of), number, np.int64)),
                    pa.array(of), item_ids.take(pa.array(of)), pa.array(found, mask=nulls), pa.array(scores),
                ],
                names=["part", "number", "at", "item_id", "doc_id", "score"],
            )

    narrow = blocks.select(F.monotonically_increasing_id().alias("at"), "ids", "sizes", "terms", "dfs", "docs", "tfs")
    lists = passes(narrow, queries, run, FOUND, **({"held": held} if held else {}))
    best = merged(lists, ["number", "at", "item_id"], "doc_id", k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_search(spark, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(spark.read.parquet(f"{folder}/benchmark.parquet"), spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH lower_ AS (SELECT doc_id, row_number() OVER () AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, d, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_ WHERE t IS NOT NULL),
p AS (SELECT doc_id, d, term, count(*) AS tf FROM w GROUP BY ALL),
s AS (SELECT d, sum(tf)::BIGINT AS n FROM p GROUP BY d),
c AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM s),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT item_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
q AS (SELECT DISTINCT item_id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
k AS (SELECT item_id, r, term, floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE)))::BIGINT AS weight FROM q JOIN f USING (term), c),
x AS (SELECT item_id, r, doc_id, d, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::BIGINT AS score
    FROM k JOIN p USING (term) JOIN s USING (d), c GROUP BY item_id, r, doc_id, d)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""
