"""Secret scans over a blob ledger.

Each content is addressed by the SHA-256 of its text, whatever paths and versions carry it. The
ledger is a Parquet table with one row per blob and pass: the rules (kind@version) scanned in that
pass and the spans found. A scan looks only at blobs that still lack a rule of the current set, and
only for the rules they lack; it appends one row per blob in one atomic write. Findings are joined
back to every row that carries the blob.

Defined cases: a null text is an empty one; repeated rows share one scan and each get the findings;
an empty table gives an empty result; other columns are ignored or, in `redact`, kept as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach.llm.arrow import map_texts
from marketreach.session import shared_folder

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern and how its matches are judged. A text without any of `anchors` can't match."""

    kind: str
    rank: int
    pattern: str
    anchors: tuple[str, ...] = ()
    group: int = 0  # group whose length counts
    least: int = 1  # its least length
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, lowered: str) -> Iterator[tuple[int, int]]:
        if self.anchors and not any(a in lowered for a in self.anchors):
            return
        for m in re.compile(self.pattern, re.ASCII).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


# The contract's three kinds, then well-known credential shapes. A maximal run of 24+
# hexadecimal digits is a greedy run that passes its length rule, likewise AKIA with 16+ more.
RULES = (
    Rule(
        "assign",
        0,
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        ("passw", "secret", "token", "apikey", "api_key"),
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Rule("hex", 2, r"[0-9a-f]{24,}"),
    Rule("private_key", 3, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", ("private key-----",)),
    Rule("github", 4, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 5, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", 6, r"AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("jwt", 7, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("url_password", 8, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@", ("://",)),
)
BASE = ("assign", "access", "hex")


def blob() -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def spans_of(text: str, rules: tuple[Rule, ...]) -> list[dict]:
    """Spans in code points by start, then rule order; ends are exclusive."""
    lowered = text.lower()
    found = [(a, r.rank, r.kind, b) for r in rules for a, b in r.spans(text, lowered)]
    return [dict(zip(("start", "rank", "kind", "end"), x)) for x in sorted(found)]


class Ledger:
    """Scans of the past, in a folder that all executors can reach."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/ledgers/{uuid.uuid4().hex}"

    def read(self) -> DataFrame | None:
        """blob, rules (array of kind@version), spans; None before the first scan."""
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger lacks of `docs` (text) and of `rules`, and append it."""
        names = F.array(*[F.lit(r.name) for r in rules])
        contents = docs.select(blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        contents = contents.groupBy("blob").agg(F.first("text").alias("text"))
        past = self.read()
        if past is None:
            todo = contents.withColumn("rules", names)
        else:
            seen = past.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
            lacking = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
            todo = contents.join(seen, "blob", "left").withColumn("rules", lacking)
            todo = todo.filter(F.size("rules") > 0).select("blob", "text", "rules")
        # blobs lacking the same rules are scanned together; there are as many sets as rule changes
        by_name = {r.name: r for r in rules}
        sets = [[r.name for r in rules]]
        if past is not None:
            sets = [r.rules for r in todo.select("rules").distinct().collect()]
        for chosen in sets:
            own = tuple(by_name[n] for n in chosen)
            part = todo if past is None else todo.filter(
                F.col("rules") == F.array(*[F.lit(n) for n in chosen])
            )

            def run(texts: list, own=own) -> dict:
                return {"spans": [spans_of(t, own) for t in texts]}

            found = map_texts(part, ["blob", "rules"], "text", run, f"spans {SPANS}")
            found.write.mode("append").parquet(self.folder)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and its spans under the given rules and versions, for blobs with at least one."""
        wanted = F.array(*[F.lit(r.name) for r in rules])
        kinds = F.transform(F.array_intersect("rules", wanted), lambda r: F.split_part(r, F.lit("@"), F.lit(1)))
        rows = self.read().filter(F.size("spans") > 0)
        rows = rows.select("blob", F.filter("spans", lambda x: F.array_contains(kinds, x["kind"])).alias("spans"))
        # a blob has a row for each pass, so for each change of rules
        merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans"))))
        return rows.filter(F.size("spans") > 0).groupBy("blob").agg(merged.alias("spans"))


def scan(docs: DataFrame, keep: list[str], ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`keep` columns and `spans` (null if there are none) of every row of `docs`."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules)
    rows = docs.select(*keep, blob().alias("_blob"))
    found = ledger.findings(rules).withColumnRenamed("blob", "_blob")
    return rows.join(found, "_blob", "left").drop("_blob")


def redact(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; `n_chars` follows if it is there.

    Overlapping spans are replaced as one, by the first of them. Rows without spans are untouched.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", blob().alias("blob"))
    both = rows.join(ledger.findings(rules), "blob", "left")

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(
            x["start"] >= acc["at"], F.struct(x["end"].cast("int").alias("at"), fresh.alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"].cast("int")).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    spans = F.transform("spans", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    clean = F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1)))
    )
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)
    done = both.select("row", F.col("spans").isNotNull().alias("hit"), text.alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secrets(spark, folder: str, ledger: Ledger | None = None) -> DataFrame:
    """Secrets of every document, from a ledger of its own unless one is given."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    found = scan(docs, ["doc_id"], ledger).select("doc_id", spans.alias("spans"))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def secrets_by_passes(spark, folder: str) -> DataFrame:
    """`op2_secrets` over a ledger that an older rule set has filled: only what it lacks is scanned."""
    ledger = Ledger(spark)
    ledger.scan(spark.read.parquet(f"{folder}/documents.parquet"), tuple(r for r in RULES if r.kind in BASE))
    return op2_secrets(spark, folder, ledger)


def _sql(rules: tuple[Rule, ...]) -> str:
    """DuckDB SQL for `op2_secrets`: matches are marked in the text and their places summed up."""
    parts = []
    for r in rules:
        pattern = r.pattern.replace("'", "''")
        short = f" WHERE length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least}"
        parts.append(f"""
        SELECT n, {r.rank} AS rank, '{r.kind}' AS kind, place AS start, place + length(m) AS stop
        FROM (SELECT n, split_part(part, chr(2), 1) AS m, k,
                length(parts[1]) + list_sum([0] || [length(x) - 1 for x in parts[2:k-1]]) AS place
              FROM (SELECT n, parts, unnest(range(2, len(parts) + 1)) AS k, parts[k] AS part
                    FROM (SELECT n, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM texts)))
        {short}""")
    names = ", ".join(f"'{k}'" for k in BASE)
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '  ') AS t FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    listed AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (kind IN ({names})) AS base,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
        FROM found GROUP BY n)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN listed USING (n)"""


SQL = _sql(RULES)
