"""Rankings over aggregated tables: Pareto, ABC, 95 % cut-off, top-k per key.

The cumulative windows run over one row per activity code. Codes are fixed-width numbers
(four digits for a class, seven for a subclass; the published table has 1,332), so the single
ordered partition they need is bounded by the code table and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach.functions.numeric import percent, share


def _running(order: list[Column]):
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _whole(order: list[Column]):
    return Window.orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each key; Spark keeps k rows per task and key before shuffling."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("posicao", rank).where(F.col("posicao") <= k)


def client_codes(
    foco: DataFrame, context: Column | None = None, value: str = "relevancia_valor"
) -> DataFrame:
    """Served portfolio by activity code: distinct ids and summed value."""
    rows = foco.where(F.col("cliente_atendido"))
    if context is not None:
        rows = rows.where(context)
    amount = F.col(value) if value in foco.columns else F.lit(0.0)
    per_id = rows.groupBy("cnae_principal", "cnae_principal_desc", "cnpj").agg(
        F.sum(amount).alias("_v")
    )
    return per_id.groupBy("cnae_principal", "cnae_principal_desc").agg(
        F.count("cnpj").alias("n_cnpjs"), F.sum("_v").alias("soma_valor")
    )


def pareto_abc(
    codes: DataFrame, metric: str, base: str = "all", k: int | None = None, tie: str = "cnae_principal"
) -> DataFrame:
    """Share, cumulative share and ABC class by a metric, descending.

    `base="all"` takes shares of the whole portfolio, `base="shown"` of the k rows kept. The row
    that crosses 80 % (95 %) is already in the later class.
    """
    order = [F.desc_nulls_last(metric), F.asc_nulls_last(tie)]
    shown = codes.orderBy(*order).limit(k) if k and base == "shown" else codes
    whole = F.sum(metric).over(_whole(order))
    out = shown.withColumns(
        {
            "pct": share(F.col(metric), whole),
            "pct_acumulado": share(F.sum(metric).over(_running(order)), whole),
        }
    )
    acc = F.col("pct_acumulado")
    out = out.withColumn("abc", F.when(acc <= 80, "A").when(acc <= 95, "B").otherwise("C"))
    return out.orderBy(*order).limit(k) if k else out


def class_totals(rows: DataFrame, value: str, cls: str = "classe") -> DataFrame:
    """Matched rows and summed value per class, from one aggregation."""
    return rows.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n_clientes"),
        F.sum(value).alias("valor_total"),
        F.count(value).alias("_com_valor"),
    )


def _up_to_share(
    table: DataFrame, name: str, amount: Column, whole: Column, order: list[Column], limit: float
) -> DataFrame:
    """Adds flag `name`: rows up to and including the first whose running share reaches the limit.

    When no row reaches it, all are inside. A NULL amount takes no part.
    """
    placed = table.withColumns(
        {
            "_pos": F.row_number().over(Window.orderBy(*order)),
            "_acc": F.sum(amount).over(_running(order)) / whole,
            "_in": amount.isNotNull(),
        }
    )
    first = F.min(F.when(F.col("_in") & (F.col("_acc") >= limit), F.col("_pos"))).over(_whole(order))
    inside = F.col("_in") & (first.isNull() | (F.col("_pos") <= first))
    return placed.withColumn(name, inside).drop("_pos", "_acc", "_in")


def class_cutoff(rows: DataFrame, value: str, limit: float = 0.95, cls: str = "classe") -> DataFrame:
    """Class summary with shares and the criterion that selects the class.

    A class is selected when it belongs to the classes that hold `limit` of the customers, or of
    the value. Value shares are 0, and select nothing, when the total value is not positive.
    """
    every = Window.orderBy(cls).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = class_totals(rows, value, cls).withColumns(
        {
            "_n": F.sum("n_clientes").over(every),
            "_v": F.coalesce(F.sum("valor_total").over(every), F.lit(0.0)),
        }
    )
    by_n = [F.desc("n_clientes"), F.asc(cls)]
    flagged = _up_to_share(totals, "_vol", F.col("n_clientes"), F.col("_n"), by_n, limit)
    amount = F.when((F.col("_com_valor") > 0) & (F.col("_v") > 0), F.col("valor_total"))
    by_v = [F.desc_nulls_last(amount), F.asc(cls)]
    flagged = _up_to_share(flagged, "_val", amount, F.col("_v"), by_v, limit)

    vol, val = F.col("_vol"), F.col("_val")
    worth = F.when(F.col("_v") > 0, F.coalesce("valor_total", F.lit(0.0))).otherwise(F.lit(0.0))
    return flagged.select(
        cls,
        "n_clientes",
        worth.alias("valor_total"),
        percent(F.col("n_clientes"), F.col("_n")).alias("pct_vol"),
        F.when(F.col("_v") > 0, percent(worth, F.col("_v"))).otherwise(F.lit(0.0)).alias("pct_val"),
        F.when(vol & val, "Vol + Val")
        .when(vol, "Volume")
        .when(val, "Valor")
        .otherwise("—")
        .alias("criterio"),
        (vol | val).alias("selecionada"),
    )


def combined_score(totals: DataFrame, key: str, count: str = "n", value: str = "valor") -> DataFrame:
    """count / max count + value / max value; a non-positive maximum value adds nothing."""
    val = F.coalesce(F.col(value), F.lit(0.0))
    every = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    max_n, max_v = F.max(count).over(every), F.max(val).over(every)
    score = F.col(count) / max_n + F.when(max_v > 0, val / max_v).otherwise(F.lit(0.0))
    return totals.withColumn("score", score).withColumn(value, val)
