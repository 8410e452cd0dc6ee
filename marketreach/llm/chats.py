"""Chat formatting after the collapse of cumulative snapshots.

A log that saves a conversation after every turn holds many conversations that are the first turns of a
longer one. Two rolling hashes run over the turns of each conversation (exclusive or of hashes salted by
the turn's rank, 128 bits together), so a prefix of n turns has a hash of its own. A conversation whose
whole hash is the hash of a shorter prefix of another one goes (anti-join on length and hash); of those
with the same turns the smallest id stays. The rest is rendered.

Ranks and rolling hashes are made in two levels, within blocks of `SPAN` turn numbers and over the
blocks, so that a conversation that holds much of the table is spread over many tasks; the text of a
turn takes no part in it. Only rendering puts a conversation together, as its result is one value.

Defined cases: turns are ordered by turn (null first), then by the MD5 of role and of text, in the SQL as
well, so that no text is moved for the order; a null role is `unknown`, a null text
empty; rows without a conv_id form one conversation; repeated rows are turns of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketreach.session import stage

SPAN = 256
OPEN, CLOSE = "<|", "|>"
SAFE = "< |"  # what an opening mark inside a text becomes


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, block, turn, role, body: with defined values."""
    return rows.select(
        "conv_id",
        F.floor(F.col("turn") / SPAN).alias("block"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"),
    )


def _before(parts: DataFrame, value: str, how) -> DataFrame:
    """`value` over the earlier blocks of a conversation; one row per block takes part."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block"))
    return parts.select("conv_id", "block", how(value).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_{k}" for k in keys])


def salted_turns(rows: DataFrame) -> DataFrame:
    """Written table (conv_id, block, n, x1, x2): rank and hashes, salted by it, of every turn."""
    narrow = turns(rows).select(
        "conv_id", "block", "turn",
        F.xxhash64("role", "body").alias("a"), F.xxhash64("body", "role", F.length("body")).alias("b"),
        F.md5("role").alias("r"), F.md5("body").alias("t"),
    )
    sizes = narrow.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "r", "t")
    ranked = _same(narrow.withColumn("k", F.row_number().over(within)), _before(sizes, "size", F.sum), ["conv_id", "block"])
    n = (F.col("k") + F.coalesce("before", F.lit(0))).cast("long").alias("n")
    return stage(
        ranked.select(
            "conv_id", "block", n, F.xxhash64(n, "a", "b").alias("x1"), F.xxhash64("b", n, "a", F.lit(7)).alias("x2")
        )
    )


def rolled(salted: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2) from the salted hashes of each turn."""
    running = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = salted.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    zero = F.lit(0).cast("long")
    earlier = blocks.select(
        "conv_id", "block",
        F.coalesce(F.bit_xor("y1").over(order), zero).alias("z1"), F.coalesce(F.bit_xor("y2").over(order), zero).alias("z2"),
    )
    own = salted.select(
        "conv_id", "block", "n", F.bit_xor("x1").over(running).alias("r1"), F.bit_xor("x2").over(running).alias("r2")
    )
    return _same(own, earlier, ["conv_id", "block"]).select(
        "conv_id", "n", F.col("r1").bitwiseXOR(F.col("z1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("z2")).alias("h2")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of another one."""
    salted = salted_turns(rows)
    whole = salted.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.bit_xor("x1").alias("h1"), F.bit_xor("x2").alias("h2")
    )
    # one row per content; a null id comes last
    content = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    size = whole.select(F.col("conv_id"), F.col("n").alias("total"))
    inner = _same(rolled(salted), size, ["conv_id"]).filter("n < total").select("n", "h1", "h2").distinct()
    return content.join(inner, ["n", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "n_copies"
    )


def render(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The conversations of `chosen`, each as one text of marked turns."""
    clean = lambda c: F.replace(F.col(c), F.lit(OPEN), F.lit(SAFE))
    piece = F.concat(F.lit(OPEN), clean("role"), F.lit(CLOSE + "\n"), clean("body"), F.lit("\n"))
    kept = _same(turns(rows), chosen, ["conv_id"])
    key = F.struct(F.col("turn").isNotNull(), "turn", F.md5("role"), F.md5("body"), piece)
    made = kept.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(key)).alias("turns"))
    return made.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["col5"]), "").alias("chat"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations with the same turns) and chat."""
    return render(rows, stage(maximal(rows)))


def op6_chats(spark, folder: str) -> DataFrame:
    """Maximal conversations as texts."""
    return format_chats(spark.read.parquet(f"{folder}/conversations.parquet"))


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 'b': body} ORDER BY turn NULLS FIRST, md5(role), md5(body)) AS l,
    string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(body, '<|', '< |') || chr(10), ''
        ORDER BY turn NULLS FIRST, md5(role), md5(body)) AS chat FROM t GROUP BY conv_id),
u AS (SELECT n, l, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(chat) AS chat FROM c GROUP BY n, l),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM u))
SELECT conv_id, n AS n_turns, n_copies, chat FROM u ANTI JOIN p USING (l)"""
