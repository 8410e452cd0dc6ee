"""Activity hierarchy saved as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketreach import layouts as L
from marketreach.functions.text import digits


def _level(*children: T.StructField) -> T.StructType:
    return T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("descricao", T.StringType()), *children]
    )


SECTION = _level()
DIVISION = _level(T.StructField("secao", SECTION))
GROUP = _level(T.StructField("divisao", DIVISION))
CLASS = _level(T.StructField("grupo", GROUP))
SUBCLASS = _level(T.StructField("classe", CLASS))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Nested subclass records, one row each."""
    return spark.read.schema(SUBCLASS).option("multiLine", "true").json(path)


def flatten_hierarchy(nested: DataFrame) -> DataFrame:
    """Five levels as flat columns; a missing level becomes an empty text."""
    paths = {
        "secao": "classe.grupo.divisao.secao",
        "divisao": "classe.grupo.divisao",
        "grupo": "classe.grupo",
        "classe": "classe",
    }
    columns = {}
    for name, path in paths.items():
        columns[name] = F.coalesce(F.col(f"{path}.id"), F.lit(""))
        columns[f"{name}_desc"] = F.coalesce(F.col(f"{path}.descricao"), F.lit(""))
    code = F.coalesce(F.col("id"), F.lit(""))
    columns["subclasse"] = digits(code)
    columns["subclasse_cod"] = code
    columns["subclasse_desc"] = F.coalesce(F.col("descricao"), F.lit(""))
    flat = nested.select(*[columns[c].alias(c) for c in L.HIERARCHY])
    return flat.orderBy("secao", "divisao", "grupo", "classe", "subclasse")
