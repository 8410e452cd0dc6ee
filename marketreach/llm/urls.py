"""URL filters: fixed rules first, then the likelihood ratio of two character models.

Models of accepted and rejected URLs are learned from the URLs that the rules judge. Both are
variable-order Markov models: a character's probability after two characters leans on the one after one
character, and that on its plain frequency, the more so the rarer the context. They read whole URLs, query
and fragment included, reduced to an alphabet of `SIZE` characters, so there are at most SIZE ** 3
trigrams: the table of log ratios has that bound whatever the input, and is broadcast. The score of a URL
is the mean log ratio of its characters. A quarter of the URLs, by their digest, is held out of the models;
the threshold is the one that separates those of them that the rules judge best (mean of both hit rates).
Log ratios are rounded to millionths, so that sums do not depend on the order of rows.

Defined cases: a URL without `://` has an empty host and path, and is scored by what it holds; a null one
counts as empty; if no held-out URL is accepted by a rule, or none rejected, the rest is allowed; ties of
thresholds go to the lowest; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach.session import stage

# Verdict, host, path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
OTHERS = r"[^a-z0-9./_?=&#:%+-]"  # replaced by ~; ^ and $ mark the ends
SIZE = 26 + 10 + 11 + 3
HELD = ("0", "1", "2", "3")  # first digits of the digests of held-out URLs
PULL = 2.0  # weight of the shorter context
UNIT = 1_000_000
BIN = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if there is none."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def trigrams(line: str = "line") -> Column:
    """Each character of a line, and its end, after the two characters before it."""
    marked = F.concat(F.lit("^^"), F.col(line), F.lit("$"))
    return F.regexp_extract_all(marked, F.lit("(?=(...))"), F.lit(1))


def line_of(url: Column) -> Column:
    """A whole URL in the alphabet of the models."""
    return F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), OTHERS, "~")


def held_out(line: str = "line") -> Column:
    """Whether a URL is kept from the models, to set the threshold."""
    return F.substring(F.md5(line), 1, 1).isin(*HELD)


def ratios(lines: DataFrame) -> DataFrame:
    """(gram, ratio): log ratio of accepted to rejected in millionths, for each trigram of `lines`.

    `lines` has line, accepted and rejected (numbers of URLs judged so by rules). Held-out lines count for
    neither kind; their trigrams still get a ratio.
    """
    learned = [F.when(held_out(), 0).otherwise(F.col(kind)).alias(kind) for kind in ("accepted", "rejected")]
    grams = lines.select(F.explode(trigrams()).alias("gram"), *learned)
    table = grams.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    a, b, c = (F.substring("gram", i, 1) for i in (1, 2, 3))
    table = table.select("*", a.alias("a"), b.alias("b"), c.alias("c"))

    def chance(kind: str) -> Column:
        """The table holds at most SIZE ** 3 rows, so these windows are bounded."""
        n = F.col(kind)
        total = lambda *keys: F.sum(n).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
        one = (total("c") + 1.0) / (total() + float(SIZE))
        two = (total("b", "c") + PULL * one) / (total("b") + PULL)
        return (n + PULL * two) / (total("a", "b") + PULL)

    return table.select(
        "gram", F.round((F.log(chance("accepted")) - F.log(chance("rejected"))) * UNIT).cast("long").alias("ratio")
    )


def scores(lines: DataFrame) -> DataFrame:
    """line, accepted, rejected and score (mean log ratio in millionths) of each line."""
    table = F.broadcast(ratios(lines))
    each = lines.select("line", F.explode(trigrams()).alias("gram")).join(table, "gram")
    score = F.floor(F.sum("ratio") / F.count("*")).cast("long")
    found = each.groupBy("line").agg(score.alias("score"))
    return lines.join(found, "line")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the lowest score to accept; null if one of the kinds has no URL."""
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
    )
    # scores are bounded, and so is the number of bins
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    lost = F.coalesce(F.sum("accepted").over(below), F.lit(0))
    caught = F.coalesce(F.sum("rejected").over(below), F.lit(0))
    accepted, rejected = F.sum("accepted").over(every), F.sum("rejected").over(every)
    rate = F.when((accepted > 0) & (rejected > 0), (accepted - lost) / accepted + caught / rejected)
    rated = bins.select("bin", rate.alias("rate"))
    return rated.agg(F.max(F.struct("rate", -F.col("bin"))).alias("best")).select(
        F.when(F.col("best.rate").isNotNull(), -F.col("best")["col2"] * BIN).alias("least")
    )


def judge(pages: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, host, path, rule, verdict and score (null where a rule decides) of every row."""
    url = F.col("url")
    rows = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), line_of(url).alias("line"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    lines = rows.groupBy("line").agg(
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("accepted"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("rejected"),
    )
    # written: read twice, and no partitioning by line that would keep a hot URL of `rows` in one task
    scored = stage(scores(lines))
    least = threshold(scored.filter(held_out())).scalar()
    judged = scored.select("line", "score", F.when(F.col("score") < least, "block").otherwise("allow").alias("own"))
    return rows.join(judged, "line").select(
        *keep, "host", "path", "rule", F.coalesce("ruled", "own").alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
    )


def op5_urls(spark, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge(spark.read.parquet(f"{folder}/pages.parquet"), ["page_id"])


def _cases(index: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(k, h + p)[index]}'"
        for k, h, p in ordered
    )
    return f"CASE{when} END"


def _chance(kind: str) -> str:
    one = f"((sum({kind}) OVER (PARTITION BY c) + 1.0::DOUBLE) / (sum({kind}) OVER () + {float(SIZE)}::DOUBLE))"
    two = f"((sum({kind}) OVER (PARTITION BY b, c) + {PULL}::DOUBLE * {one}) / (sum({kind}) OVER (PARTITION BY b) + {PULL}::DOUBLE))"
    return f"(({kind} + {PULL}::DOUBLE * {two}) / (sum({kind}) OVER (PARTITION BY a, b) + {PULL}::DOUBLE))"


_HELD = f"substring(md5(line), 1, 1) IN {HELD}"
SQL = f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_cases(1)} AS rule, {_cases(0)} AS ruled,
    regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '{OTHERS}', '~', 'g') AS line FROM cut),
lines AS (SELECT line, count(*) FILTER (ruled = 'allow') AS accepted, count(*) FILTER (ruled = 'block') AS rejected FROM ruled GROUP BY line),
grams AS (SELECT line, {_HELD} AS held, accepted, rejected, substring('^^' || line || '$', i, 3) AS gram
    FROM (SELECT *, unnest(range(1, length(line) + 2)) AS i FROM lines)),
tabled AS (SELECT gram, gram[1] AS a, gram[2] AS b, gram[3] AS c, CAST(sum(CASE WHEN held THEN 0 ELSE accepted END) AS DOUBLE) AS accepted,
    CAST(sum(CASE WHEN held THEN 0 ELSE rejected END) AS DOUBLE) AS rejected FROM grams GROUP BY gram),
ratios AS (SELECT gram, CAST(round((ln({_chance("accepted")}) - ln({_chance("rejected")})) * {UNIT}) AS BIGINT) AS ratio FROM tabled),
scored AS (SELECT line, any_value(accepted) AS accepted, any_value(rejected) AS rejected,
    CAST(floor(CAST(sum(ratio) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM grams JOIN ratios USING (gram) GROUP BY line),
bins AS (SELECT floor(score / {BIN}.0::DOUBLE) AS bin, CAST(sum(accepted) AS DOUBLE) AS accepted, CAST(sum(rejected) AS DOUBLE) AS rejected FROM scored WHERE {_HELD} GROUP BY bin),
rated AS (SELECT bin, sum(accepted) OVER () AS a, sum(rejected) OVER () AS r,
    coalesce(sum(accepted) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
    coalesce(sum(rejected) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught FROM bins),
best AS (SELECT bin * {BIN} AS least FROM rated WHERE a > 0 AND r > 0 ORDER BY (a - lost) / a + caught / r DESC, bin LIMIT 1)
SELECT page_id, host, path, rule,
    coalesce(ruled, CASE WHEN score < (SELECT least FROM best) THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN rule IS NULL THEN score END AS score
FROM ruled JOIN scored USING (line)"""
