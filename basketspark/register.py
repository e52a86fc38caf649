"""The library's functions for SQL users, who can't reach column expressions: Arrow twins of them, and a table function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .functions import parse, similarity, text

_SHORT = re.compile(r"(?<!\w)(?:(?<!f )eks|" + "|".join(k for k in text.ABBREVIATIONS if k != "eks") + r")(?!\w)")
_WEIGHT = re.compile(rf"(?:([0-9]+)\s*x\s*)?({parse.NUMBER})\s*{parse.UNIT}")
_FACTORS = {"kg": 1000.0, "l": 1000.0, "ltr": 1000.0, "liter": 1000.0, "litre": 1000.0, "cl": 10.0, "dl": 100.0}


def normalize_name(x: str | None) -> str:
    """``text.normalized`` of one name."""
    if x is None or x == "nan":
        return ""
    x = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if unicodedata.category(c) != "Mn")
    for old, new in (("&", "and"), ("+", "and"), (",", " "), ("'", ""), ("’", ""), (".", " ")):
        x = x.replace(old, new)
    x = _SHORT.sub(lambda m: text.ABBREVIATIONS[m[0]], x)
    for word in text.NOISE:
        x = x.replace(word, "")
    return " ".join(re.sub(r"(?<!\w)okologisk(?!\w)", "", x).replace("/", " ").split())


def parse_weight_g(x: str | None) -> float | None:
    """``parse.weight_grams`` of one text."""
    m = _WEIGHT.fullmatch((x or "").strip(" ").lower())
    return round(int(m[1] or 1) * float(m[2].replace(",", ".")) * _FACTORS.get(m[3], 1.0), 3) if m else None


@F.pandas_udf(StringType())
def _normalize_name(x: pd.Series) -> pd.Series:
    return x.map(normalize_name)


@F.pandas_udf(DoubleType())
def _parse_weight_g(x: pd.Series) -> pd.Series:
    return x.map(parse_weight_g).astype(float)


@F.udtf(returnType=StructType([StructField("position", IntegerType()), StructField("quantity", DoubleType()), StructField("unit", StringType()), StructField("name", StringType())]))
class ParseIngredients:
    """A row for each line of a recipe."""

    def eval(self, lines: str) -> Iterator[tuple]:
        for i, line in enumerate((lines or "").split("\n")):
            line = line.strip()
            m = re.match(parse.LINE, line)
            if not line:
                continue
            if not m:
                yield i, None, "", line
                continue
            parts = [float(n.replace(",", ".")) for n in re.split("[/-]", m[1])]
            whole = parts[0] if len(parts) == 1 else parts[0] / parts[1] if "/" in m[1] and parts[1] else sum(parts) / 2 if "-" in m[1] else None
            yield i, whole, parse.MEASURES[m[2].lower()] if m[2] else "", m[3].strip()


def register(spark: SparkSession) -> None:
    """fuzzy_score(a, b), normalize_name(x), parse_weight_g(x), and the table function parse_ingredients(text)."""
    spark.udf.register("fuzzy_score", similarity._score)
    spark.udf.register("normalize_name", _normalize_name)
    spark.udf.register("parse_weight_g", _parse_weight_g)
    spark.udtf.register("parse_ingredients", ParseIngredients)
