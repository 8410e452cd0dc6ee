"""Quality rules in a ledger of bits.

Every rule is evaluated once per document: the ledger keeps the measurements and one long in which bit r
is set if rule r failed. A policy is a version and the rules it applies; whether it keeps a document is
one bitwise test of the ledger. Ablations (what a policy would keep without one of its rules) come from
counts per bit pattern, of which there are at most 2 to the number of rules, whatever the corpus.

Defined cases: a null text has no words and fails the base rules; repeated rows each get a row; an empty
table gives an empty ledger and no ablation counts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach.llm.arrow import map_texts
from marketreach.session import stage

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition on the measurements holds."""

    name: str
    fails: str


# The place of a rule is its bit; rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Rules that a version applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


POLICIES = (
    Policy("base", BASE),
    Policy("v1", tuple(r.name for r in RULES)),
)


def measure(text: bytes | None) -> tuple[int, ...]:
    """Measurements of a UTF-8 text, with the number of its lines that have a word."""
    data = text or b""
    words = data.split()  # bytes: ASCII blanks only
    n = len(words)
    joined = b"".join(words)
    # code points: bytes that don't continue another
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        place: dict[bytes, int] = {}
        ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, n)
        k = len(place)
        pairs = ids[:-1] * k + ids[1:]
        if k >= 2**21:  # keep three words within 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, inverse, count = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def ledger(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, the measurements, and `failed`: bit r is set if rule r failed."""
    names = (*MEASURES, "n_lines")

    def run(texts: list) -> dict:
        return dict(zip(names, map(list, zip(*map(measure, texts)))))

    measured = map_texts(docs, keep, "text", run, ", ".join(f"{n} long" for n in names), raw=True)
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def fails(mask: int) -> Column:
    """Whether any of the rules of a mask failed."""
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0


def keeps(policy: Policy) -> Column:
    """Whether a policy keeps a document of the ledger."""
    return ~fails(policy.mask)


def ablations(held: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, without (a rule, null for none), n_kept, n_all: from counts per bit pattern."""
    patterns = held.groupBy("failed").agg(F.count("*").alias("n"))
    trials = [(p.version, None, p.mask) for p in policies]
    for p in policies:
        trials += [(p.version, r.name, p.mask & ~(1 << i)) for i, r in enumerate(RULES) if r.name in p.rules]
    listed = [
        F.struct(F.lit(v).alias("version"), F.lit(w).cast("string").alias("without"), F.lit(m).cast("long").alias("mask"))
        for v, w, m in trials
    ]
    # both are bounded by the rules, not by the corpus
    each = patterns.select("failed", "n", F.explode(F.array(*listed)).alias("trial"))
    kept = F.sum(F.when(F.col("failed").bitwiseAND(F.col("trial.mask")) == 0, F.col("n")).otherwise(0))
    return each.groupBy("trial.version", "trial.without").agg(kept.alias("n_kept"), F.sum("n").alias("n_all"))


def op10_quality(spark, folder: str) -> DataFrame:
    """Measurements, failure bits and verdict of the current policy for every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base, current = POLICIES[0], POLICIES[-1]
    return ledger(docs, ["doc_id"]).select(
        "doc_id", *MEASURES, "failed", fails(base.mask).alias("base_failed"), (keeps(base) & keeps(current)).alias("kept")
    )


def quality_ablations(spark, folder: str) -> DataFrame:
    """What every policy keeps, whole and without each of its rules, from the stored ledger of all documents."""
    held = stage(ledger(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]))
    return ablations(held)


_BLANK = r"[^\x20\x09-\x0D]+"
_BITS = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
listed AS (SELECT n, doc_id, t, regexp_extract_all(t, '{_BLANK}') AS w,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '{_BLANK}')] AS l FROM docs),
windows AS (SELECT n, unnest(range(1, len(w) - 1)) AS i, w FROM listed WHERE len(w) >= 3),
found AS (SELECT n, i, count(*) OVER (PARTITION BY n, w[i], w[i+1], w[i+2]) AS c FROM windows),
covered AS (SELECT n, count(DISTINCT k) AS n_repeat_words
    FROM (SELECT n, unnest([i, i + 1, i + 2]) AS k FROM found WHERE c > 1) GROUP BY n),
measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines
    FROM listed LEFT JOIN covered USING (n)),
bits AS (SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))} AS BIGINT) AS failed FROM measured)"""
SQL = f"""{_BITS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
    failed & {POLICIES[0].mask} <> 0 AS base_failed, failed & {POLICIES[-1].mask | POLICIES[0].mask} = 0 AS kept
FROM bits"""
_TRIALS = ", ".join(
    f"('{p.version}', {f"'{name}'" if name else 'NULL'}, {sum(1 << i for i, r in enumerate(RULES) if r.name in p.rules and r.name != name)})"
    for p in POLICIES
    for name in (None, *p.rules)
)
ABLATIONS_SQL = f"""{_BITS}
SELECT version, without, CAST(count(*) FILTER (failed & mask = 0) AS BIGINT) AS n_kept, count(*) AS n_all
FROM bits, (VALUES {_TRIALS}) AS trials(version, without, mask) GROUP BY version, without"""
