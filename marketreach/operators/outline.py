"""Outline text (one row per line) to flat activity records.

Heading lines set a level and clear the levels below; other lines are notes of the open subclass.
A level is therefore known from the last heading of each kind: it holds when it stands after the
last heading of every higher level. "Last heading so far" is a running maximum, so a document is
cut into chunks of lines that are scanned independently, and only one summary row per chunk is
carried over. A document that holds most of the lines is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.text import digits
from marketreach.operators.joins import keep_one

CHUNK_LINES = 10_000
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """`doc, line_no, line` from whole texts."""
    split = F.posexplode(F.split(F.col(text), LINE_BREAKS))
    return docs.select(F.col(doc).alias("doc"), split.alias("line_no", "line"))


def _tagged(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """Line kind, chunk and one struct column per level (NULL off its headings)."""
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = lines.select(
        "doc", F.col("line_no").cast("long").alias("line_no"), line.alias("line")
    ).where(F.length("line") > 0)
    kind = F.lit(None).cast("string")
    for level, pattern in reversed(L.HEADINGS.items()):
        kind = F.when(F.col("line").rlike(pattern), level).otherwise(kind)
    rows = rows.withColumn("kind", kind).withColumn(
        "chunk", F.floor(F.col("line_no") / chunk_lines)
    )

    def heading(level: str) -> Column:
        part = [F.trim(F.regexp_extract("line", L.HEADINGS[level], i)) for i in (1, 2)]
        return F.when(
            F.col("kind") == level,
            F.struct(F.col("line_no").alias("at"), part[0].alias("cod"), part[1].alias("nome")),
        )

    return rows.withColumns({level: heading(level) for level in L.HEADINGS})


def parse_outline(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """One record per subclass heading: the five levels and its notes.

    `lines` holds `doc, line_no, line`; line numbers order a document.
    """
    levels = list(L.HEADINGS)
    rows = _tagged(lines, chunk_lines)
    chunks = rows.groupBy("doc", "chunk").agg(*[F.max(v).alias(f"_{v}") for v in levels])
    earlier = Window.partitionBy("doc").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("doc", "chunk", *[F.max(f"_{v}").over(earlier).alias(f"_{v}") for v in levels])
    so_far = (
        Window.partitionBy("doc", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    state = rows.select(
        "doc", "line_no", "line", "kind", "chunk",
        *[F.max(v).over(so_far).alias(v) for v in levels],
    ).join(carried, ["doc", "chunk"])
    state = state.withColumns(
        {v: F.greatest(F.col(v), F.col(f"_{v}")) for v in levels}  # skips NULLs
    )

    def holds(level: str) -> Column:
        """The level's last heading stands after the last heading of every higher level."""
        ok = F.col(level).isNotNull()
        for upper in levels[: levels.index(level)]:
            ok = ok & (F.col(f"{level}.at") > F.coalesce(F.col(f"{upper}.at"), F.lit(-1)))
        return ok

    def part(level: str, field: str) -> Column:
        return F.when(holds(level), F.col(f"{level}.{field}")).otherwise(F.lit(""))

    open_sub = state.where(holds("subclasse"))
    records = open_sub.where(F.col("kind") == "subclasse").select(
        "doc",
        "line_no",
        *[part(v, f).alias(f"{v}_{'cod' if f == 'cod' else 'nome'}") for v in levels for f in ("cod", "nome")],
    )
    notes = (
        open_sub.where(F.col("kind").isNull())
        .groupBy("doc", F.col("subclasse.at").alias("line_no"))
        .agg(F.collect_list(F.struct(F.col("line_no").alias("n"), "line")).alias("_l"))
        .select(
            "doc", "line_no",
            F.array_join(F.transform(F.array_sort("_l"), lambda x: x["line"]), " ").alias("_notes"),
        )
    )
    return records.join(notes, ["doc", "line_no"], "left").select(
        *records.columns, F.coalesce("_notes", F.lit("")).alias("notas_explicativas")
    )


def merge_editions(records: DataFrame, edition: str) -> DataFrame:
    """One record per subclass over all editions: the last edition, and its last mention, wins."""
    keyed = records.withColumn("subclasse_cod_num", digits(F.col("subclasse_cod")))
    best = keep_one(
        keyed, ["subclasse_cod_num"], [-F.col(edition), -F.col("line_no"), F.col("doc")]
    )
    return best.orderBy("secao_cod", "divisao_cod", "grupo_cod", "classe_cod", "subclasse_cod")
