"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves over a binary trie.

The trie of all distinct fingerprints is walked from the root as pairs of nodes with the bits in
which their prefixes differ. A pair over the error budget is pruned with everything below it. Spark
walks the upper levels, `STEP` bits a round, until no node of a pair holds more than `LEAF`
fingerprints; tasks walk the rest of each pair bit by bit. Equal fingerprints are one member, so
copies of a text never make pairs.

Defined cases: a null text is an empty one; no word gives fingerprint 0, linked like any other;
fewer words than a shingle make one shingle; repeated rows each get a row; a component whose ids are
all null has a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach.llm.arrow import map_texts
from marketreach.llm.components import connected
from marketreach.session import stage

BITS = 64
WORDS = 3
MAX_BITS = 2
SEED = 42
STEP = 4
LEAF = 8192  # most fingerprints of one trie node in a task
BLOCK = 65_536  # shingles hashed at a time
FRONT = 500_000  # node pairs held at a time
DIRECT = 32  # node pairs of at most so many member pairs are compared directly


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text; a bit is set where over half of the hashes set it."""
    found = (text or b"").lower().split()  # bytes: A-Z and ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    size = max(len(found) - words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends))[:size]
    ends = ends[-size:] - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, size, BLOCK):
        bounds = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > size).tolist())


def fingerprints(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """`keep` columns and `fp`, the fingerprint as a signed long."""

    def run(texts: list) -> dict:
        return {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, keep, "text", run, "fp long", raw=True)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each of `n` nodes' components under links u-v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def pair_links(a: np.ndarray, b: np.ndarray | None, used: int, depth: int, budget: int) -> Iterator[tuple]:
    """(i, j) arrays of members of two sorted trie nodes within `budget` differing bits.

    `used` bits differ in the first `depth` bits. `b` is None for a node paired with itself; then
    i < j. Node pairs are index ranges; a stack keeps the number held at a time bounded.
    """
    same, b = b is None, a if b is None else b
    first = [np.array([x]) for x in (0, len(a), 0, len(b), used)]
    stack = [(depth, first)]
    while stack:
        depth, (a0, a1, b0, b1, used) = stack.pop()
        small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (depth == BITS)
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            each = na * nb
            of = np.repeat(np.arange(len(each)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = a0[small][of] + k // nb[of], b0[small][of] + k % nb[of]
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                hit &= i < j
            if hit.any():
                yield i[hit], j[hit]
            a0, a1, b0, b1, used = (x[~small] for x in (a0, a1, b0, b1, used))
        if not len(a0):
            continue
        shift = np.uint64(BITS - 1 - depth)
        ones_a, ones_b = (
            np.concatenate(([0], np.cumsum((x >> shift) & np.uint64(1)).astype(np.int64))) for x in (a, b)
        )
        am, bm = a1 - (ones_a[a1] - ones_a[a0]), b1 - (ones_b[b1] - ones_b[b0])
        # a range paired with itself has its two halves paired once
        once = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        parts = [
            (a0, am, b0, bm, used, np.ones(len(a0), bool)),
            (am, a1, bm, b1, used, np.ones(len(a0), bool)),
            (a0, am, bm, b1, used + 1, np.ones(len(a0), bool)),
            (am, a1, b0, bm, used + 1, ~once),
        ]
        ok = [p[5] & (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget) for p in parts]
        below = [np.concatenate([p[n][k] for p, k in zip(parts, ok)]) for n in range(5)]
        for at in range(0, len(below[0]), FRONT):
            stack.append((depth + 1, [x[at : at + FRONT] for x in below]))


def _link_pairs(budget: int):
    """mapInArrow function: trie node pairs to a spanning forest of their links."""

    def forest(a, b, used, depth):
        a = np.sort(a)
        b = None if b is None else np.sort(b)
        members = a if b is None else np.concatenate((a, b))
        label = np.arange(len(members))
        offset = 0 if b is None else len(a)
        held: list = []
        for i, j in pair_links(a, b, used, depth, budget):
            held.append((label[i], label[j + offset]))
            if sum(len(x[0]) for x in held) > FRONT:
                label = roots(len(members), *map(np.concatenate, zip(*held)))[label]
                held = []
        if held:
            label = roots(len(members), *map(np.concatenate, zip(*held)))[label]
        moved = np.flatnonzero(label != np.arange(len(members)))
        return members[moved], members[label[moved]]

    def run(batches):
        for batch in batches:
            rows = (batch.column(c) for c in ("depth", "same", "used", "left", "right"))
            for depth, same, used, left, right in zip(*rows):
                a = np.asarray(left.values).view(np.uint64)
                b = None if same.as_py() else np.asarray(right.values).view(np.uint64)
                u, v = forest(a, b, used.as_py(), depth.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]
                )

    return run


def _node(depth: int):
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def links(members: DataFrame, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """(u, v): a forest that joins all distinct `fp` within `budget` bits, directly or over others.

    `members` holds each fingerprint once and is read once a round, so it should be a written table.
    """
    spark = members.sparkSession
    front = spark.range(1).select(
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("used")
    )
    done, nodes, depth = [], [], 0
    while True:
        sizes = members.groupBy(_node(depth).alias("node")).agg(F.count("*").alias("n"))
        sized = stage(
            front.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
            .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
            .withColumn("closed", (F.greatest("n_a", "n_b") <= leaf) | F.lit(depth >= BITS))
        )
        done.append(sized.filter("closed").select("depth", "a", "b", "used"))
        nodes.append(members.select(F.lit(depth).alias("depth"), _node(depth).alias("node"), "fp"))
        opened = sized.filter("not closed")
        if opened.isEmpty():
            break
        depth += STEP
        low = F.lit((1 << STEP) - 1).cast("long")
        child = members.select(_node(depth).alias("c")).distinct().select(
            F.shiftrightunsigned("c", STEP).alias("p"), "c"
        )
        left = child.select(F.col("p").alias("a"), F.col("c").alias("ca"))
        right = child.select(F.col("p").alias("b"), F.col("c").alias("cb"))
        more = F.bit_count(F.col("ca").bitwiseAND(low).bitwiseXOR(F.col("cb").bitwiseAND(low)))
        met = opened.select("a", "b", "used").join(left, "a").join(right, "b")
        front = met.filter((F.col("ca") <= F.col("cb")) | (F.col("a") < F.col("b"))).filter(
            F.col("used") + more <= budget
        ).select(
            F.lit(depth).alias("depth"), F.col("ca").alias("a"), F.col("cb").alias("b"), (F.col("used") + more).alias("used")
        )
    pairs = done[0]
    every = nodes[0]
    for d, n in zip(done[1:], nodes[1:]):
        pairs, every = pairs.unionByName(d), every.unionByName(n)
    # at most `leaf` members: no node with more is part of a closed pair
    wanted = pairs.select("depth", F.explode(F.array("a", "b")).alias("node")).distinct()
    lists = every.join(wanted, ["depth", "node"], "left_semi").groupBy("depth", "node").agg(
        F.collect_list("fp").alias("fps")
    )
    left = lists.select("depth", F.col("node").alias("a"), F.col("fps").alias("left"))
    right = lists.select("depth", F.col("node").alias("b"), F.col("fps").alias("right"))
    own = pairs.filter("a = b").join(left, ["depth", "a"]).select(
        "depth", F.lit(True).alias("same"), "used", "left", F.array().cast("array<bigint>").alias("right")
    )
    two = pairs.filter("a <> b").join(left, ["depth", "a"]).join(right, ["depth", "b"]).select(
        "depth", F.lit(False).alias("same"), "used", "left", "right"
    )
    return own.unionByName(two).mapInArrow(_link_pairs(budget), "u long, v long")


def components(
    docs: DataFrame, words: int = WORDS, budget: int = MAX_BITS, leaf: int = LEAF
) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row of `docs`."""
    marked = stage(fingerprints(docs, ["doc_id"], words))
    members = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected(stage(links(members.select("fp"), budget, leaf)))
    named = members.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stage(named.join(least, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """One row of each component, with all its columns: the least by doc_id (null last), text hash, columns.

    Rows that repeat a doc_id with different texts are told apart. Equal rows are one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.xxhash64(*columns).alias("c"), "doc_id", F.xxhash64("text").alias("h"), "text", F.struct(*columns).alias("row")
    )
    marked = stage(fingerprints(rows, ["c", "doc_id", "h"], words))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h", "c")
    members = stage(marked.groupBy("fp").agg(F.min(order).alias("least")))
    found = connected(stage(links(members.select("fp"), budget, leaf)))
    named = members.join(found, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = stage(named.groupBy("root").agg(F.min("least").alias("least")).select("least.c", "least.h"))
    chosen = rows.select("c", "h", "row").join(kept, ["c", "h"], "left_semi")
    return chosen.groupBy("c", "h").agg(F.first("row").alias("row")).select("row.*")


def op1_simhash(spark, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return components(docs).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
