"""Prefix trie of conversations: double arrays per prefix shard, shared upper nodes merged globally.

Conversations are rebuilt, reduced to one row per distinct sequence of turns, and dealt to shards by
their first turns. The depth of the cut is found in rounds (0, 1, 2, 4 ... turns): a prefix that more
than `LEAF` distinct sequences share is cut again at twice the depth, so no shard grows with a hot first
turn. A task numbers the turns of a shard densely, packs the shard's trie into BASE and CHECK arrays (the
child of state s under turn id c is slot BASE[s] + c, and CHECK of that slot is s), walks all sequences
over them, and adds up its nodes from the leaves. Nodes above the cuts are shared by shards: what each
shard's top counted, and the sequences that end above a cut, meet there in one global aggregation.

A digest of members is taken over a list in order, so it is one stream per sequence: its ids are
sorted and joined in ranges first, and what meets is those parts, read one after the other.

Defined cases: rows without a conv_id take no part; a null role or text is empty; turns of one number
are in order of role, then text; repeated rows are turns of their own; the remainder of a negative id
has its sign; an empty table has no node; other columns are ignored. A task holds the turn ids of one
conversation (20 bytes a turn, without text) and those of a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach.llm.blocks import blocks_of, stage_blocks
from marketreach.session import stage

GROUP = 20  # conversations that share the first turns of one of them
SHARED = 4  # one more than the most turns that are shared
LEAF = 4096  # most sequences of a shard
PACKED = 1 << 18  # turns of small shards in one double array
TEXT = 1 << 16  # most characters of a part of a member list
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = "depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOUND = f"shard long, parent_conv_id long, top boolean, {NODE}"


def ranked(rows: DataFrame) -> DataFrame:
    """conv_id, n (rank from 1) and the turn's content: a and b (128 bits together) and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return plain.select(
        "conv_id", F.row_number().over(order).alias("n"), half(1).alias("a"), half(17).alias("b"),
        F.regexp_count("text", F.lit(WORD)).alias("words"),
    )


def _taken() -> Column:
    """Turns that a conversation takes over."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (a, b, words), of every rebuilt conversation."""
    own = stage(ranked(rows))
    convs = own.groupBy("conv_id").agg(F.max("n").alias("size")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lead"), _taken().alias("h")
    )
    shared = own.filter(F.col("n") < SHARED).withColumnRenamed("conv_id", "lead")
    before = convs.join(shared, "lead").filter("n <= h").select("conv_id", F.lit(0).alias("late"), "n", "a", "b", "words")
    after = own.filter(F.col("n") > _taken()).select("conv_id", F.lit(1).alias("late"), "n", "a", "b", "words")
    none = convs.select("conv_id", *[F.lit(None).cast("int").alias(c) for c in ("late", "n")],
                        *[F.lit(None).cast("long").alias(c) for c in ("a", "b")], F.lit(None).cast("int").alias("words"))
    every = before.unionByName(after).unionByName(none)  # a conversation may be left without a turn
    turn = F.when(F.col("n").isNotNull(), F.struct("late", "n", "a", "b", "words"))
    return every.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words"))).alias("turns")
    )


def _key(depth: int | Column) -> Column:
    """128 bits that tell prefixes of `depth` turns apart."""
    part = lambda c: F.slice(F.col(f"turns.{c}"), 1, depth)
    return F.struct(F.xxhash64(part("a"), part("b")).alias("x"), F.xxhash64(F.lit(7), part("b"), part("a")).alias("y"))


def digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256, from (key, conv_id): parts of the list are made in ranges, then streamed in order."""

    def gathered(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(rows, lambda r: len(r[-1]), 16 * TEXT, 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block)], names=names)

    def parts(batches) -> Iterator[tuple]:
        key, first, held, size = None, 0, [], 0
        for batch in batches:
            for x, y, c in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "conv_id"))):
                if (x, y) != key or size > TEXT:
                    if held:
                        yield *key, first, ",".join(map(str, held))
                    key, first, held, size = (x, y), c, [], 0
                held.append(c)
                size += 20
        if held:
            yield *key, first, ",".join(map(str, held))

    def whole(batches) -> Iterator[tuple]:
        key, digest = None, None
        for batch in batches:
            for x, y, part in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "part"))):
                if (x, y) == key:
                    digest.update(b"," + part.encode())
                    continue
                if key:
                    yield *key, digest.hexdigest()
                key, digest = (x, y), hashlib.sha256(part.encode())
        if key:
            yield *key, digest.hexdigest()

    narrow = members.select("key.x", "key.y", "conv_id")
    order = ["x", "y", "conv_id"]
    lists = narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda b: gathered(parts(b), ["x", "y", "low", "part"]), "x long, y long, low long, part string"
    )
    met = lists.repartition("x", "y").sortWithinPartitions("x", "y", "low")
    found = met.mapInArrow(lambda b: gathered(whole(b), ["x", "y", "ends_sha256"]), "x long, y long, ends_sha256 string")
    return found.select(F.struct("x", "y").alias("key"), "ends_sha256")


def sequences(rows: DataFrame) -> DataFrame:
    """Written table of distinct sequences: key, turns, size, n_convs, conv_id (smallest) and ends_sha256."""
    convs = stage(rebuilt(rows).select("conv_id", "turns", F.struct(F.size("turns").alias("size"), _key(F.size("turns")).alias("at")).alias("whole")))
    keyed = convs.select("conv_id", "turns", F.struct(F.col("whole.at.x").alias("x"), F.xxhash64("whole.at.y", "whole.size").alias("y")).alias("key"))
    found = keyed.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    some = keyed.join(found.select(F.col("conv_id").alias("c")), F.col("conv_id") == F.col("c"), "left_semi").select("key", "turns")
    return stage(some.join(found, "key").join(digests(keyed), "key").withColumn("size", F.size("turns")))


def shards(seqs: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Written tables: sequences with `cut` and `shard` (the key of their first `cut` turns), and those that end above a cut."""
    rest, cut = seqs, 0
    done, above = [], []
    while True:
        at = rest.withColumn("shard", _key(cut))
        big = at.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)
        big = stage(big.select("shard"))
        done.append(at.join(big, "shard", "left_anti").withColumn("cut", F.lit(cut)))
        if big.isEmpty():
            break
        more = max(2 * cut, 1)
        opened = at.join(big, "shard", "left_semi").drop("shard")
        above.append(opened.filter(F.col("size") < more))
        rest, cut = stage(opened.filter(F.col("size") >= more)), more
    closed, ended = done[0], seqs.limit(0)
    for part in done[1:]:
        closed = closed.unionByName(part)
    for part in above:
        ended = ended.unionByName(part)
    return stage(closed), stage(ended)


class DoubleArray:
    """Trie of sequences of dense ids as BASE and CHECK arrays.

    Sequences lie in `flat` from `starts` on; the longest come first.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        size = int(flat.max(initial=-1)) + 2 + 2 * len(sizes)
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0  # the root is its own parent
        self.free = 1  # no slot before this one is free
        state = np.zeros(len(sizes), np.int64)
        for depth, n in lengths(sizes):
            codes = flat[starts[:n] + depth]
            pairs = np.unique(np.stack([state[:n], codes], axis=1), axis=0)
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            first, counts = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(pairs)])))
            for i in np.argsort(-counts, kind="stable").tolist():
                if counts[i] == 1:
                    break
                self._place(int(pairs[first[i], 0]), pairs[first[i] : first[i] + counts[i], 1])
            lone = first[counts == 1]
            self._place_lone(pairs[lone, 0], pairs[lone, 1])
            state[:n] = self.step(state[:n], codes)

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            more += len(self.base) // 2
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def _place(self, state: int, codes: np.ndarray) -> None:
        """Children of one state: the first base at which all their slots are free."""
        span = int(codes[-1] - codes[0]) + 1
        at = self.free
        while True:
            self._grow(at + 2 * span + 64)
            open_ = np.flatnonzero(self.check[at : len(self.check) - span] < 0)
            for low in range(0, len(open_), 64):
                starts = open_[low : low + 64] + at
                fits = (self.check[starts[:, None] + (codes - codes[0])] < 0).all(axis=1)
                if fits.any():
                    base = int(starts[fits.argmax()] - codes[0])
                    self.base[state] = base
                    self.check[base + codes] = state
                    return
            at = max(at, len(self.check) - span)

    def _place_lone(self, states: np.ndarray, codes: np.ndarray) -> None:
        """Only children: one free slot each."""
        if not len(states):
            return
        while True:
            slots = np.flatnonzero(self.check[self.free :] < 0)[: len(states)] + self.free
            if len(slots) == len(states):
                break
            self._grow(len(self.check) + len(states))
        self.base[states] = slots - codes
        self.check[slots] = states
        self.free = int(slots[-1]) + 1

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Child of each state under each id, -1 where there is none."""
        to = self.base[states] + codes
        fine = (to > 0) & (to < len(self.check))
        return np.where(fine & (self.check[np.where(fine, to, 0)] == states), to, -1)


def lengths(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each depth, and how many sequences, the longest first, go beyond it."""
    for depth in range(int(sizes[0]) if len(sizes) else 0):
        yield depth, int(np.searchsorted(-sizes, -depth, "left"))


def nodes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays by node, the root first and parents before children: depth, parent (a place in the arrays), and what it counts.

    `end` is the sequence that ends at a node, or -1; `through` one that passes it. The longest sequences come first.
    """
    trie = DoubleArray(flat, starts, sizes)
    slots = len(trie.check)
    n_convs, first = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    last_words, depths, through = (np.zeros(slots, np.int64) for _ in range(3))
    ends, state, order = np.full(slots, -1, np.int64), np.zeros(len(sizes), np.int64), [np.zeros(1, np.int64)]
    n_convs[0], first[0] = counts.sum(), firsts.min()
    for depth, n in lengths(sizes):
        state[:n] = here = trie.step(state[:n], flat[starts[:n] + depth])
        assert (here > 0).all(), "a sequence left the trie"
        last_words[here], depths[here], through[here] = words[starts[:n] + depth], depth + 1, np.arange(n)
        order.append(np.unique(here))
        np.add.at(n_convs, here, counts[:n])
        np.minimum.at(first, here, firsts[:n])
    ends[state] = np.arange(len(sizes))
    n_children, n_leaves = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    saved = (n_convs - 1) * last_words
    for depth in range(len(order) - 1, -1, -1):
        here = order[depth]
        n_leaves[here] += n_children[here] == 0
        if depth:
            parent = trie.check[here]
            np.add.at(n_children, parent, 1)
            np.add.at(n_leaves, parent, n_leaves[here])
            np.add.at(saved, parent, saved[here])
    kept = np.concatenate(order)
    place = np.zeros(slots, np.int64)
    place[kept] = np.arange(len(kept))
    return {
        "depth": depths[kept], "parent": place[trie.check[kept]], "n_convs": n_convs[kept], "conv_id": first[kept],
        "n_children": n_children[kept], "n_leaves": n_leaves[kept], "saved": saved[kept], "end": ends[kept], "through": through[kept],
    }


def _shard_nodes(batches) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows of (number, cut, seqs), one per shard, to the nodes of the shards.

    Small shards are packed together: a shard is then the first turn of its sequences, under a root of no meaning.
    """
    for batch in batches:
        turns = np.array([len(s.values.field("turns").flatten()) + len(s) for s in batch.column("seqs")])
        at = 0
        for block in blocks_of(iter(turns.tolist()), lambda n: n, PACKED, 1 << 62):
            yield _packed_nodes(batch.slice(at, len(block)))
            at += len(block)


def _packed_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    seqs = batch.column("seqs")
    shard = np.repeat(np.arange(len(seqs)), seqs.value_lengths().to_numpy())
    rows = seqs.flatten()
    order = np.argsort(-rows.field("turns").value_lengths().to_numpy(), kind="stable")
    rows, shard = rows.take(pa.array(order)), shard[order]
    turns = rows.field("turns")
    sizes = turns.value_lengths().to_numpy().astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(int(sizes.sum()), bool)
    inner[starts] = False
    flat, words = np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int64)
    values = turns.flatten()
    pairs = np.stack([values.field(c).to_numpy() for c in ("a", "b")], axis=1)
    flat[inner] = np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1)
    words[inner] = values.field("words").to_numpy()
    flat[starts], words[starts] = shard, rows.field("top_words").to_numpy()
    found = nodes(flat, starts, sizes, words, rows.field("n_convs").to_numpy(), rows.field("conv_id").to_numpy())
    digest = np.array([*rows.field("ends_sha256").to_pylist(), EMPTY], object)[found["end"]]
    parents, of = found["conv_id"][found["parent"]], shard[found["through"]]
    top = found["depth"] == 1
    numbers, cuts = batch.column("number").to_numpy(), batch.column("cut").to_numpy()
    columns = [
        numbers[of], pa.array(parents, mask=top), top, found["depth"] - 1 + cuts[of], found["n_convs"], found["conv_id"],
        found["n_children"], found["n_leaves"], found["saved"], pa.array(digest, pa.string()),
    ]
    names = [f.split()[0] for f in FOUND.split(", ")]
    made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
    return made.slice(1)  # without the root


def _path(last: Column) -> Column:
    """Keys of the prefixes of 0 to `last` turns."""
    return F.transform(F.sequence(F.lit(0), last), lambda d: F.struct(d.alias("depth"), _key(d).alias("key")))


def upper_nodes(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes above the cuts: key, parent (key) and the columns of `NODE`.

    `tops` are shards' tops (cut, path, n_convs, conv_id, n_leaves, saved_tokens, words of the turns on the path),
    `ended` the sequences that end above a cut.
    """
    zero = F.lit(0).cast("long")
    from_tops = tops.select(
        F.slice("path", 1, F.col("cut")).alias("path"), "words", "n_convs", "conv_id", "n_leaves", "saved_tokens",
        F.col("path")[F.col("cut")]["key"].alias("child"), F.lit(None).cast("string").alias("ends_sha256"),
    )
    from_ended = ended.select(
        _path(F.col("size")).alias("path"), F.col("turns.words").alias("words"), "n_convs", "conv_id", zero.alias("n_leaves"),
        zero.alias("saved_tokens"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("child"), "ends_sha256",
    )
    each = from_tops.unionByName(from_ended).select("*", F.posexplode("path").alias("d", "node"))
    last = F.size("path") - 1 == F.col("d")
    on = stage(each.select(
        F.col("d").alias("depth"), F.col("node.key").alias("key"),
        F.when(F.col("d") > 0, F.col("path")[F.col("d") - 1]["key"]).alias("parent"),
        F.when(F.col("d") > 0, F.get("words", F.col("d") - 1)).otherwise(0).alias("words"),
        F.slice("path", 1, F.col("d") + 1)["key"].alias("keys"),
        "n_convs", "conv_id", "n_leaves", "saved_tokens",
        F.when(last, F.col("child")).alias("child"), F.when(last, F.col("ends_sha256")).alias("ends_sha256"),
    ))
    sums = stage(on.groupBy("depth", "key").agg(
        F.first("parent").alias("parent"), F.first("words").alias("words"), F.first("keys").alias("keys"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("below"),
        F.sum("saved_tokens").alias("saved_below"), F.max("ends_sha256").alias("ends_sha256"),
    ))
    # a top is a child of its last upper node; so is the next upper node of the one before
    children = (
        on.filter("child IS NOT NULL").select(F.col("key").alias("parent"), F.col("child").alias("key"), (F.col("depth") + 1).alias("depth"))
        .unionByName(sums.filter("parent IS NOT NULL").select("parent", "key", "depth"))
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count_distinct("key").alias("n_children"))
    )
    own = stage(
        sums.join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", zero))
        .withColumn("own_leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words"))
    )
    upward = own.filter("own_leaf > 0 OR own_saved <> 0").select(F.posexplode("keys").alias("depth", "key"), "own_leaf", "own_saved")
    added = upward.groupBy("depth", "key").agg(F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved"))
    return stage(own.join(added, ["depth", "key"], "left").select(
        "key", "parent", F.col("depth").cast("long").alias("depth"), "n_convs", "conv_id", "n_children",
        (F.col("below") + F.coalesce("leaves", zero)).alias("n_leaves"),
        (F.col("saved_below") + F.coalesce("saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    ))


def trie(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    seqs = sequences(rows)
    closed, ended = shards(seqs, leaf)
    cut = F.col("cut")
    below = F.struct(
        F.slice("turns", cut + 1, F.greatest(F.size("turns") - cut, F.lit(0))).alias("turns"),
        F.when(cut > 0, F.get("turns.words", cut - 1)).otherwise(0).cast("long").alias("top_words"),
        "n_convs", "conv_id", "ends_sha256",
    )
    # at most `leaf` sequences of a shard
    packed = stage(closed.groupBy("cut", "shard").agg(F.collect_list(below).alias("seqs"), F.first("turns").alias("turns")).withColumn(
        "number", F.monotonically_increasing_id()
    ))
    found = stage_blocks(packed.select("number", "cut", "seqs").mapInArrow(_shard_nodes, FOUND))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if packed.filter("cut > 0").isEmpty():
        return found.select(*columns)
    paths = packed.filter("cut > 0").select("number", "cut", _path(cut).alias("path"), F.slice("turns.words", 1, cut).alias("words"))
    tops = stage(found.filter("top").join(paths, F.col("shard") == F.col("number")))
    upper = upper_nodes(tops, ended)
    names = upper.select(F.col("depth").alias("up_depth"), F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    parent = lambda df, key: df.join(
        names, (F.col("depth") - 1 == F.col("up_depth")) & (key == F.col("up")), "left"
    ).withColumn("parent_conv_id", F.col("up_conv"))
    shared = parent(upper, F.col("parent")).select(*columns)
    first = parent(tops.drop("parent_conv_id"), F.col("path")[F.col("cut") - 1]["key"]).select(*columns)
    # a shard at depth 0 has no top to name: it is then the only one
    return found.filter("not top").select(*columns).unionByName(first).unionByName(shared)


def op13_trie(spark, folder: str) -> DataFrame:
    """Nodes of the prefix trie of the conversations."""
    return trie(spark.read.parquet(f"{folder}/conversations.parquet"))


SQL = r"""
WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM o GROUP BY conv_id),
h AS (SELECT conv_id, l, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS INTEGER) AS h FROM g),
r AS (SELECT h.conv_id, list_concat(coalesce(p.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN h p ON p.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(l) AS size, d, l[1:d] AS p FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM m GROUP BY d, p),
c AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, p)),
u AS (SELECT a AS d, p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM k) GROUP BY ALL)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, u.n_leaves, u.saved_tokens, k.ends_sha256
FROM k JOIN u USING (d, p) LEFT JOIN n q ON q.d = k.d - 1 AND q.p = k.p[1:k.d - 1] AND k.d > 0"""
