"""JSON of any shape as VARIANT: kinds, elements, recordsets, pools of references, and what a shared cart keeps of what it's sent.

Defined results: text that isn't JSON is null, as is a field that is missing, null or of
another type than asked for; numbers are read as the type asked for where nothing is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: The limits of a shared cart's items, by field, and how many it has.
CART_TEXTS = {"p": 64, "n": 120, "i": 300, "s": 40}
CART_ITEMS, CART_MOST = 100, 99


def parsed(c: Column) -> Column:
    """A text as VARIANT, or null where it isn't JSON."""
    return F.try_parse_json(c)


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; no kind for what is missing."""
    name = F.schema_of_variant(v)
    out = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
    out = out.when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
    return F.when(v.isNotNull(), out.otherwise("other"))


def elements(v: Column) -> Column:
    """The elements of an array in order, none for all else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def field(v: Column, name: str, type_: str = "variant") -> Column:
    """A field of an object, by its name as it is."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"no path has a name with both kinds of quotes: {name}")
    return F.try_variant_get(v, f"$[{quote}{name}{quote}]", type_)


def text_of(v: Column) -> Column:
    """A value as text: a text without quotes, numbers and all else as JSON; null for null."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(kind(v).isin("object", "array"), F.to_json(v)))


def records(v: Column, fields: Mapping[str, str]) -> Column:
    """The objects of an array as structs of typed fields; other elements are left out."""
    objects = F.filter(elements(v), lambda x: kind(x) == "object")
    return F.transform(objects, lambda x: F.struct(*(field(x, n, t).alias(n) for n, t in fields.items())))


def recordset(rows: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """A row for each object in a column's arrays: the other columns, and the fields as columns."""
    if clash := set(fields) & (set(rows.columns) - {column}):
        raise ValueError(f"fields named as columns of the rows: {sorted(clash)}")
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.inline(records(F.col(column), fields)))


def cart_items(v: Column) -> Column:
    """What a shared cart keeps of an array: its first hundred objects with an id, texts cut, quantities of 1 to 99 and prices that are numbers."""

    def item(x: Column) -> Column:
        # texts of digits count as numbers, as they do in what is sent
        quantity = F.when(text_of(field(x, "q")).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text_of(field(x, "q"))).try_cast("int"))
        price = F.when(text_of(field(x, "pr")).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text_of(field(x, "pr")).try_cast("double"))
        cut = {n: F.substring(F.coalesce(text_of(field(x, n)), F.lit("")), 1, most).alias(n) for n, most in CART_TEXTS.items()}
        return F.struct(cut["p"], F.greatest(F.lit(1), F.least(F.lit(CART_MOST), F.coalesce(quantity, F.lit(1)))).alias("q"), cut["n"], cut["i"], cut["s"], price.alias("pr"))

    objects = F.filter(elements(v), lambda x: kind(x) == "object")
    return F.slice(F.filter(F.transform(objects, item), lambda x: x["p"] != ""), 1, CART_ITEMS)


def followed(pool: Column, v: Column) -> Column:
    """What a reference leads to: a whole number is a place in the pool, all else stands for itself."""
    return let(v, lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "BIGINT", F.get(pool, F.try_variant_get(x, "$", "int"))), x))


def at_path(pool: Column, v: Column, path: str) -> Column:
    """The value at a path of field names with dots between, each followed through the pool."""
    return functools.reduce(lambda x, name: followed(pool, field(x, name)), path.split("."), v)


def pool_records(rows: DataFrame, text_col: str, fields: Mapping[str, tuple[str, str]], having: Sequence[str] = (), equal: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each object of a page's pool that has the fields of ``having`` and, at the paths of ``equal``, these texts.

    ``fields`` maps columns to (path, type). Objects are filtered and read within their row,
    so the pool isn't copied for each of them. The other columns of the rows stay.
    """
    keep = [c for c in rows.columns if c != text_col and c not in fields]
    pool = F.col(text_col)

    def wanted(x: Column) -> Column:
        tests = [kind(x) == "object", *(field(x, n).isNotNull() for n in having)]
        tests += [F.try_variant_get(at_path(pool, x, p), "$", "string") == value for p, value in (equal or {}).items()]
        return functools.reduce(lambda a, b: a & b, tests)

    def read(x: Column) -> Column:
        return F.struct(*(F.try_variant_get(at_path(pool, x, p), "$", t).alias(n) for n, (p, t) in fields.items()))

    parsed_rows = rows.select(*keep, elements(parsed(F.col(text_col))).alias(text_col))
    return parsed_rows.select(*keep, F.inline(F.transform(F.filter(pool, wanted), read)))
