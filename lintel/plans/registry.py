"""Where queries are kept, and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ZWNJ, ZWSP, RLO, TAG = "‌", "​", "‮", "\U000e0001"


def injected(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """documents with marks put into t: the given texts have none."""
    mark = lambda n, c: F.when(F.col("doc_id") % n == 0, F.lit(c)).otherwise("")
    text = F.col("text")
    t = F.concat(text.substr(1, 10), mark(4, ZWNJ), text.substr(11, 10), mark(3, ZWSP), F.substr(text, F.lit(21)), mark(5, RLO), mark(7, TAG))
    return table(spark, sf_dir, "documents").select("doc_id", *columns, t.alias("t"))


#: The same relation in SQL.
INJ = """inj as (select doc_id, lang, source, substring(text, 1, 10) || case when doc_id % 4 = 0 then chr(8204) else '' end || substring(text, 11, 10)
  || case when doc_id % 3 = 0 then chr(8203) else '' end || substring(text, 21) || case when doc_id % 5 = 0 then chr(8238) else '' end
  || case when doc_id % 7 = 0 then chr(917505) else '' end as t from documents)"""
