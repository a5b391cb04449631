"""extract_joins(language, text) for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

RETURNS = "left_table string, right_table string, join_type string, condition string, line int, implicit boolean, ambiguous boolean"


class ExtractJoins:
    def eval(self, language: str, text: str):
        from edgeloom.operators.extract import analyse

        if language is not None and text is not None:
            for j in analyse(text, language).joins:
                yield j["left_table"], j["right_table"], j["join_type"], j["condition"], j["line"], j["implicit"], j["ambiguous"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_joins", udtf(ExtractJoins, returnType=RETURNS))
