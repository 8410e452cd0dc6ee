"""Benchmark decontamination by spaced seeds.

Fixed masks select some of the next tokens of each position; the selected tokens are hashed. Hashes of
documents and of benchmark items are joined, and each diagonal (document position less item position)
with a hit is verified: a document holds an item if, on that diagonal, a window of
`WINDOW` tokens of the item (the whole item if it is shorter) has at least `SHARE` of its tokens in
place. Every window within that share contains a hit of a mask for items of its length, so the result
is that of matching all windows: `MASKS` serve items of `WINDOW` tokens and more, `LIGHT` shorter ones,
and items of fewer than four tokens, where no token may differ, are hashed as a whole.

A Bloom filter of fixed size over the item hashes, read as a scalar, keeps most positions of documents
out of the join; it only saves work. All masks of two tokens and more select two neighbours, so that
pairs of these are looked up first, and single tokens beside them. What remains of a document is kept in blocks of `BLOCK` positions with
their surroundings, written once. Texts are told apart by their MD5, so copies are verified once.

Defined cases: null and empty texts hold nothing; items without a token are never found; each character
of a script without spaces is a token; items with the same tokens count as the one with the smallest id,
but `op8_decontaminate` names each of them; repeated rows each get their pairs; empty tables give no pairs; other columns are ignored or, in `keep_clean`, kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach.session import stage

MASKS = ("111111", "1101101001", "11010001011")  # 1: selected
LIGHT = ("1111", "11011", "11101", "10111")
WINDOW = 13
# (mask, shortest, longest item it serves)
SEEDS = (
    *[(m, WINDOW, None) for m in MASKS],
    *[(m, 4, WINDOW - 1) for m in LIGHT],
    *[("1" * n, n, n) for n in (1, 2, 3)],
)
UNSPACED = (
    # none is below U+0E00, which is tested first
    r"([\x{0E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]])"
)
SHARE = 0.8
BLOCK = 64
WORDS_LOG2 = 16  # the filter is an array of so many longs, as a power of two: 0.5 MB


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def tokens(text: str = "text") -> Column:
    """Hashes of a text's tokens: lower-cased runs of letters and digits, characters of unspaced scripts."""
    apart = F.regexp_replace(F.lower(F.col(text)), UNSPACED, " $1 ")
    words = F.split(F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _pairs(t: str) -> Column:
    """Hash of each token and the next."""
    return F.transform(F.col(t), lambda x, i: F.xxhash64(x, F.get(F.col(t), i + 1)))


def _hash(t: str, mask: int, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(F.col(t), at + o) for o in _places(SEEDS[mask][0])])


_SINGLE = next(i for i, s in enumerate(SEEDS) if s[0] == "1")


def _slots(h: Column) -> list[tuple[Column, Column]]:
    """(word, bit) of the filter for a hash, twice."""
    low = F.lit((1 << WORDS_LOG2) - 1).cast("long")
    word = lambda by: F.shiftrightunsigned(h, by).bitwiseAND(low).cast("int")
    bit = lambda by: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return [(word(48), bit(42)), (word(20), bit(8))]


def bloom(hashes: DataFrame) -> DataFrame:
    """One row: the filter over the column `h`, as an array of 2 ** WORDS_LOG2 longs."""
    each = F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _slots(F.col("h"))])).alias("s")
    found = hashes.select(each).groupBy(F.col("s.w").alias("w"), F.col("s.b").alias("b")).count()
    words = found.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    spark = hashes.sparkSession
    every = spark.range(1 << WORDS_LOG2).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    entry = F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return every.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]).alias("bits"))


def _in(bits: Column, h: Column) -> Column:
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    tests = [F.call_function("shiftrightunsigned", F.get(bits, w), b).bitwiseAND(one) != zero for w, b in _slots(h)]
    return reduce(lambda a, b: a & b, tests)


def _once(value: Column) -> Column:
    """A value that is made once a row.

    It passes a generator, behind which the optimizer doesn't look: otherwise a value named inside a
    lambda may be moved there and made anew for each element.
    """
    return F.explode(F.array(value))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, t): items with a token; of those with the same tokens the smallest id."""
    rows = benchmark.select("item_id", tokens().alias("t")).filter(F.size("t") > 0)
    return rows.groupBy("t").agg(F.min("item_id").alias("item_id"))


def named(benchmark: DataFrame) -> DataFrame:
    """(first, item_id): every item id beside the id that `items` keeps for its tokens."""
    rows = benchmark.select("item_id", tokens().alias("t")).filter(F.size("t") > 0).distinct()
    return rows.join(items(benchmark).withColumnRenamed("item_id", "first"), "t").select("first", "item_id")


def item_seeds(found: DataFrame) -> DataFrame:
    """(item_id, q, h) of every mask at every position it fits."""
    parts = []
    for m, (mask, least, most) in enumerate(SEEDS):
        at = F.explode(F.sequence(F.lit(0), F.size("t") - len(mask))).alias("q")
        served = F.col("size").between(max(least, len(mask)), most) if most else F.col("size") >= least
        fits = found.withColumn("size", F.size("t")).filter(served).select("item_id", "t", at)
        parts.append(fits.select("item_id", "q", _hash("t", m, F.col("q")).alias("h")))
    return reduce(DataFrame.unionByName, parts)


def candidates(docs: DataFrame, keep: list[str], found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Written table: `keep`, key (MD5), block, its tokens from `start` on, hits (i, h), `first`.

    A row of `docs` has a row here for each block with a hit in the filter; `first` marks one of them.
    """
    near = found.select(F.explode(F.when(F.size("t") > 1, F.slice(_pairs("t"), 1, F.size("t") - 1))).alias("h"))
    pairs = near.unionByName(found.filter(F.size("t") == 1).select(_hash("t", _SINGLE, F.lit(0)).alias("h")))
    bits = bloom(stage(seeds.select("h").unionByName(pairs).distinct())).scalar()
    # the optimizer moves the scalar column into its only use, so no row carries the filter
    single = found.agg((F.coalesce(F.min(F.size("t")), F.lit(0)) == 1).alias("single")).scalar()
    rows = docs.select(*keep, F.md5("text").alias("key"), _once(tokens()).alias("t")).withColumn("bits", bits)
    rows = rows.withColumn("single", single)

    def seeded(at: Column) -> Column:
        """Masks whose first two selected neighbours are at `at` and after it."""
        made = []
        for m, (mask, _, _) in enumerate(SEEDS):
            i = at - max(mask.find("11"), 0)
            made.append((i, F.when((i >= 0) & (i <= F.size("t") - len(mask)), _hash("t", m, i))))
        return F.array(*[F.struct(i.alias("i"), h.alias("h")) for i, h in made])

    def found_in(b: Column, single: Column) -> Column:
        meets = lambda h, i: F.when(_in(b, h) | (single & _in(b, _hash("t", _SINGLE, i))), i)
        near = F.filter(F.transform(_pairs("t"), meets), lambda i: i.isNotNull())
        every = F.flatten(F.transform(near, seeded))
        return F.filter(every, lambda x: x["h"].isNotNull() & _in(b, x["h"]))

    hits = F.get(
        F.transform(F.array(F.struct("bits", "single")), lambda x: found_in(x["bits"], x["single"])), F.lit(0)
    )
    rows = rows.select(*keep, "key", "t", hits.alias("hits"))
    numbers = F.array_distinct(F.transform("hits", lambda x: F.floor(x["i"] / BLOCK).cast("int")))
    rows = rows.select(*keep, "key", "t", "hits", F.explode_outer(numbers).alias("block")).filter("block is not null")
    start = F.greatest(F.col("block") * BLOCK - WINDOW, F.lit(0))
    return stage(
        rows.select(
            *keep, "key", "block", start.alias("start"),
            F.slice("t", start + 1, F.lit(BLOCK + 2 * WINDOW)).alias("part"),
            F.filter("hits", lambda x: F.floor(x["i"] / BLOCK) == F.col("block")).alias("hits"),
            (F.col("block") == F.floor(F.array_min("hits")["i"] / BLOCK)).alias("first"),
        )
    )


def verify(blocks: DataFrame, found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, item_id, position, matched): texts that hold an item, with the best window.

    `matched` is the most tokens in place in a window, `position` the first token of the first such.
    """
    met = blocks.select("key", "block", F.explode("hits").alias("hit")).select(
        "key", "block", F.col("hit.i").alias("i"), F.col("hit.h").alias("h")
    )
    met = met.join(seeds, "h").select("key", "block", "item_id", (F.col("i") - F.col("q")).alias("diagonal")).distinct()
    own = blocks.groupBy("key", "block").agg(F.first("start").alias("start"), F.first("part").alias("part"))
    rows = met.join(own, ["key", "block"]).join(found, "item_id")
    shift = F.col("diagonal") - F.col("start")
    equal = F.transform("t", lambda x, q: F.coalesce((F.get(F.col("part"), q + shift) == x).cast("int"), F.lit(0)))
    rows = rows.select("key", "item_id", "diagonal", F.size("t").alias("m"), _once(equal).alias("e"))

    rows = rows.select("*", F.least("m", F.lit(WINDOW)).alias("v"))
    window = F.transform(
        F.sequence(F.lit(0), F.col("m") - F.col("v")),
        lambda q: F.struct(
            F.aggregate(F.slice("e", q + 1, F.col("v")), F.lit(0), lambda a, x: a + x).alias("matched"),
            (-(F.col("diagonal") + q)).alias("back"),
        ),
    )
    best = _once(F.array_max(window))
    rows = rows.select("key", "item_id", "v", best.alias("best")).filter(F.col("best.matched") >= F.ceil(F.col("v") * SHARE))
    top = rows.groupBy("key", "item_id").agg(F.max("best").alias("best"))
    return top.select("key", "item_id", (-F.col("best.back")).alias("position"), F.col("best.matched").alias("matched"))


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, key, item_id, position and matched of every document that holds an item."""
    found = stage(items(benchmark))
    seeds = stage(item_seeds(found))
    blocks = candidates(docs, keep, found, seeds)
    held = verify(blocks, found, seeds)
    return blocks.filter("first").select(*keep, "key").join(held, "key")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that hold no benchmark item."""
    found = stage(items(benchmark))
    seeds = stage(item_seeds(found))
    blocks = candidates(docs, [], found, seeds)
    held = stage(verify(blocks, found, seeds).select("key").distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("key"))
    return row.join(held, "key", "left_anti").select("row.*")


def op8_decontaminate(spark, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = overlaps(docs, benchmark, ["doc_id"]).withColumnRenamed("item_id", "first")
    return found.join(named(benchmark), "first").select("doc_id", "item_id", "position", "matched")
