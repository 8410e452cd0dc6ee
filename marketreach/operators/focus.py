"""Focus table: register rows of the chosen classes, marked with the customer list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach.functions.numeric import decimal_comma
from marketreach.functions.predicates import in_classes
from marketreach.functions.text import class_of, code_label, described, root_of
from marketreach.operators.joins import keep_one, own_exchange
from marketreach.operators.ranking import top_per_key
from marketreach.session import stage


def matched_rows(enriched: DataFrame, value: str) -> DataFrame:
    """Matched customer rows with class and numeric value."""
    rows = enriched.where(F.col("cnae_principal").isNotNull())
    return rows.withColumn("classe", class_of(F.col("cnae_principal"))).withColumn(
        value, decimal_comma(F.col(f"`{value}`"))
    )


def class_descriptions(hierarchy: DataFrame) -> DataFrame:
    """One description per 4-digit class."""
    rows = hierarchy.select(
        F.substring("subclasse", 1, 4).alias("classe"), "classe_desc", "subclasse"
    )
    return keep_one(rows, ["classe"], [F.col("subclasse"), F.col("classe_desc")]).drop("subclasse")


def describe_classes(classes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Adds `classe_desc`, empty when the class is not in the hierarchy."""
    out = classes.join(class_descriptions(hierarchy), "classe", "left")
    return out.withColumn("classe_desc", F.coalesce("classe_desc", F.lit("")))


def label_codes(rows: DataFrame, hierarchy: DataFrame, limit: int = 55) -> DataFrame:
    """Adds `rotulo`: code and description (hierarchy, else own, else the code)."""
    names = hierarchy.select(F.col("subclasse").alias("cnae_principal"), F.col("subclasse_desc").alias("_h"))
    own = F.col("cnae_principal_desc") if "cnae_principal_desc" in rows.columns else F.lit(None)
    desc = described(F.col("_h"), own, F.col("cnae_principal"))
    joined = rows.join(names, "cnae_principal", "left")
    return joined.withColumn("rotulo", code_label(F.col("cnae_principal"), desc, limit)).drop("_h")


def class_top_subclasses(rows: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent activity codes inside each class."""
    counts = rows.groupBy("classe", "cnae_principal").agg(F.count(F.lit(1)).alias("n_clientes"))
    return top_per_key(counts, ["classe"], [F.desc("n_clientes"), F.asc("cnae_principal")], k)


def filter_classes(base: DataFrame, classes: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the given classes (a list, or a table with column `classe`).

    A table of classes is staged first: it is the end of a long plan over the customer list, and
    its real size lets the optimizer filter the register without moving it.
    """
    if not isinstance(classes, DataFrame):
        return base.where(in_classes(F.col("cnae_principal"), classes))
    wanted = stage(classes.select("classe").distinct())
    keyed = base.withColumn("_cls", class_of(F.col("cnae_principal")))
    return keyed.join(wanted.withColumnRenamed("classe", "_cls"), "_cls", "left_semi").drop("_cls")


def mark_served(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """LEFT join of the per-customer aggregate; unmatched rows are not served.

    A classification column whose name is taken becomes `cli_<name>`.
    """
    renames = {
        c: f"cli_{c}" for c in customers.columns if c in rows.columns and c != "cnpj"
    }
    joined = rows.join(own_exchange(customers.withColumnsRenamed(renames)), "cnpj", "left")
    return joined.withColumn(
        "cliente_atendido", F.coalesce(F.col("cliente_atendido"), F.lit(False))
    )


def mark_company(rows: DataFrame) -> DataFrame:
    """Adds `empresa_base_atendida`: another row of the same company root is served.

    The served roots are aggregated on their own and joined back, so a company with very many
    establishments is never gathered in one window. The rows are staged, since both sides read them
    and they stand at the end of the joins with the register and the customer list.
    """
    rows = stage(rows)
    root = root_of(F.col("cnpj"))
    served = (
        rows.where(F.col("cliente_atendido"))
        .select(root.alias("_root"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    joined = rows.withColumn("_root", root).join(own_exchange(served), "_root", "left")
    return joined.withColumn(
        "empresa_base_atendida", F.coalesce(F.col("_hit"), F.lit(False))
    ).drop("_root", "_hit")
