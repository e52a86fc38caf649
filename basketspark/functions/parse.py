"""Parsing of messy retail strings, as column expressions.

Bad input gives null unless a function says otherwise; nothing raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
JUNK = ("", "none", "nan", "null", "undefined", "nat", "<na>")


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    """A regular expression's group, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def decimal_comma(c: Column) -> Column:
    return _double(F.replace(c, F.lit(","), F.lit(".")))


def price(c: Column) -> Column:
    """A price with currency words; 0.0 where there is none."""
    return F.coalesce(decimal_comma(F.trim(F.regexp_replace(F.lower(c), r"dkk|kr\.?", ""))), F.lit(0.0))


def unit_price(c: Column) -> Column:
    """The first number of "84,62 kr/kg"."""
    return decimal_comma(_group(c, f"({NUMBER})"))


def leaflet_price(c: Column) -> Column:
    """The last number in a leaflet's text: '.' between thousands, ',' before decimals; null unless positive."""
    found = F.regexp_extract_all(c, F.lit(r"([0-9]{1,3}(?:[.][0-9]{3})+(?:,[0-9]{1,2})?|[0-9]+(?:,[0-9]{1,2})?)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    value = _double(F.replace(F.replace(last, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.when(value > 0, value)


def _grams(amount: Column, unit: Column) -> Column:
    unit = F.lower(unit)
    factor = (
        F.when(unit.isin("g", "gr", "gram", "ml"), 1.0)
        .when(unit.isin("kg", "l", "ltr", "liter", "litre"), 1000.0)
        .when(unit == "cl", 10.0)
        .when(unit == "dl", 100.0)
    )
    return F.round(amount * factor, 3)


UNIT = r"(kg|gram|gr|g|ml|cl|dl|liter|litre|ltr|l)"
#: What may stand between words, and a number as feeds write it; "1.2.3" is none.
BLANK, LOOSE_NUMBER = r"[\s\p{Z}]*", r"[0-9.,]+"


def weight_grams(c: Column) -> Column:
    """"500 g", "1,5 l" (a litre counts as a kilogram) or the total of "6 x 0.33 liter" or "6 x 33 cl.", but not of no pieces."""
    text = F.lower(c)
    single = rf"^{BLANK}({LOOSE_NUMBER}){BLANK}{UNIT}{BLANK}$"
    packs = rf"^{BLANK}([0-9]+){BLANK}x{BLANK}({LOOSE_NUMBER}){BLANK}{UNIT}\.?{BLANK}$"
    pieces = _group(text, packs).try_cast("int")
    return F.coalesce(
        _grams(decimal_comma(_group(text, single)), _group(text, single, 2)),
        F.when(pieces > 0, _grams(pieces * decimal_comma(_group(text, packs, 2)), _group(text, packs, 3))),
    )


def piece_count(weight: Column, name: Column | None = None) -> Column:
    """Pieces of a whole "10 stk" (whole ones of "10.5 st"); else a loose "10 stk" in the weight, then in the name."""
    loose = rf"(?<![\p{{L}}\p{{N}}_])([0-9]+){BLANK}stk(?![\p{{L}}\p{{N}}_])"
    whole = decimal_comma(_group(F.lower(weight), rf"^{BLANK}({LOOSE_NUMBER}){BLANK}stk?{BLANK}$"))
    found = [F.floor(whole).try_cast("int"), _group(F.lower(weight), loose).try_cast("int")]
    if name is not None:
        found.append(_group(F.lower(name), loose).try_cast("int"))
    return F.coalesce(*found)


def price_per_kg(price_: Column, grams: Column) -> Column:
    return F.when((price_ > 0) & (grams > 0), F.round(price_ * 1000 / grams, 2))


def repaired_price(price_: Column, per_kg: Column, grams: Column) -> Column:
    """A price far from what the unit price says is replaced by it."""
    expected = per_kg * grams / 1000
    return F.when((expected > 0) & ((price_ > 2.5 * expected) | (price_ < 0.3 * expected)), F.round(expected, 2)).otherwise(price_)


def is_cheaper(new: Column, now: Column) -> Column:
    return new < now - 0.001


def is_equal_price(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 0.01


def effective_price(list_price: Column, sale_price: Column) -> Column:
    return F.coalesce(sale_price, list_price)


def deal_size(c: Column) -> Column:
    n = _group(c, rf"(?i)^\s*([0-9]+)\s*for\s*({NUMBER})").try_cast("int")
    return F.when((n > 1) & (deal_total(c, False) > 0), n)


def deal_total(c: Column, checked: bool = True) -> Column:
    total = decimal_comma(_group(c, rf"(?i)^\s*([0-9]+)\s*for\s*({NUMBER})", 2))
    return F.when(deal_size(c).isNotNull(), total) if checked else total


def bundle_price(price_: Column, quantity: Column, n: Column, total: Column) -> Column:
    """What a number of pieces cost where ``n`` cost ``total``: full bundles and a rest at the single price."""
    rest = quantity - F.floor(quantity / n) * n
    return F.round(F.coalesce(F.floor(quantity / n) * total + rest * price_, quantity * price_), 2)


def deal_price(price_: Column, quantity: Column, deal: Column) -> Column:
    """What a number of pieces cost under "N for P"."""
    return bundle_price(price_, quantity, deal_size(deal), deal_total(deal))


def quantity(c: Column) -> Column:
    """"1/2", "3-4" (the mean) or "1,5"."""
    text = F.trim(c)
    part = lambda p, i: decimal_comma(_group(text, p, i))
    fraction, span = rf"^({NUMBER})/({NUMBER})$", rf"^({NUMBER})-({NUMBER})$"
    return F.coalesce(
        F.try_divide(part(fraction, 1), part(fraction, 2)), (part(span, 1) + part(span, 2)) / 2, part(rf"^({NUMBER})$", 1)
    )


#: Spellings of measures in recipes.
MEASURES = {
    "g": "g", "gram": "g", "gr": "g", "kg": "kg", "kilo": "kg", "l": "l", "liter": "l", "dl": "dl", "cl": "cl", "ml": "ml",
    "spsk": "spsk", "spiseske": "spsk", "spiseskeer": "spsk", "ss": "spsk", "tsk": "tsk", "teske": "tsk", "teskeer": "tsk", "ts": "tsk",
    "stk": "stk", "styk": "stk", "stykker": "stk", "fed": "fed", "dåse": "dåse", "dåser": "dåse", "ds": "dåse", "pakke": "pakke", "pk": "pakke", "pakker": "pakke",
    "bundt": "bundt", "knivspids": "knivspids", "håndfuld": "håndfuld", "fl": "flaske", "flaske": "flaske", "flasker": "flaske", "glas": "glas",
}
LINE = rf"(?i)^((?:{NUMBER})(?:[/-](?:{NUMBER}))?)\s*(?:({'|'.join(sorted(MEASURES, key=len, reverse=True))})\.?\s)?\s*(.+)$"


def ingredient(c: Column) -> Column:
    """A struct of quantity, unit and name of a line such as "2 dl mælk"; without a number, all of it is the name."""
    text = F.trim(c)
    amount, unit = _group(text, LINE), F.coalesce(_group(F.lower(text), LINE, 2), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    return F.struct(
        quantity(amount).alias("quantity"),
        F.when(amount.isNull(), "").otherwise(F.coalesce(F.try_element_at(known, unit), unit)).alias("unit"),
        F.trim(F.coalesce(_group(text, LINE, 3), text)).alias("name"),
    )


def nutrition_number(c: Column, kcal: bool = False) -> Column:
    """The number of "< 0,5 g" or "1.542 kJ / 366 kcal" (the part in kcal, if asked for)."""
    text = F.regexp_replace(F.lower(c), "[<≤~]", "")
    if kcal:
        text = F.coalesce(_group(text, r"([0-9][0-9.,]*)\s*kcal"), text)
    text = _group(text, r"([0-9][0-9.,]*)")
    comma = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    thousands = F.when(text.rlike(r"^[0-9]{1,3}([.][0-9]{3})+$"), F.replace(text, F.lit("."), F.lit("")))
    return _double(F.when(text.contains(","), comma).otherwise(F.coalesce(thousands, text)))


def is_ean(c: Column) -> Column:
    return F.coalesce(c.rlike("^([0-9]{8}|[0-9]{12,14})$"), F.lit(False))


def duration_minutes(c: Column) -> Column:
    """Hours and minutes of an ISO-8601 duration; null if that is nothing."""
    part = lambda x: F.coalesce(_group(c, rf"T(?:[0-9]+[A-Z])*?([0-9]+){x}").try_cast("int"), F.lit(0))
    total = part("H") * 60 + part("M")
    return F.when(total > 0, total)


def sale_end(c: Column) -> Column:
    """"dd/MM" of the second time in "start/end"."""
    return F.date_format(F.try_to_timestamp(F.substring(F.split_part(c, F.lit("/"), F.lit(2)), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "dd/MM")


def number_text(c: Column) -> Column:
    """One decimal, a comma, and no zero behind it."""
    return F.regexp_replace(F.replace(F.format_string("%.1f", F.round(c, 1)), F.lit("."), F.lit(",")), ",0$", "")


def ean_id(ean: Column) -> Column:
    return F.concat(F.lit("ean_"), F.substring(F.md5(ean), 1, 10))


def name_id(normal_name: Column, grams: Column) -> Column:
    return F.concat(F.lit("store_"), F.substring(F.md5(F.concat_ws("_", normal_name, F.round(F.coalesce(grams, F.lit(0.0))).cast("long").cast("string"))), 1, 8))


def cleaned(c: Column) -> Column:
    """Null for texts that only say that there is nothing."""
    return F.when(~F.lower(F.trim(c)).isin(*JUNK), F.trim(c))


def like_escaped(c: Column) -> Column:
    return F.regexp_replace(F.substring(F.lower(F.trim(c)), 1, 60), r"([%_\\])", r"\\$1")


def without_store_brand(c: Column, brands: tuple[str, ...]) -> Column:
    """The name without a store's own brand in front; capitals throughout become a sentence."""
    pattern = "(?i)^(?:" + "|".join(b.replace(".", r"\.") for b in sorted(brands, key=len, reverse=True)) + r")\s+"
    rest = F.regexp_replace(F.trim(c), pattern, "")
    sentence = F.concat(F.upper(F.substring(rest, 1, 1)), F.lower(F.substring(rest, 2, 1_000_000)))
    raised = F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1_000_000))
    return F.when((rest == F.upper(rest)) & (rest != F.lower(rest)), sentence).otherwise(raised)


def compact_cart(items: Column, most: int | None = 100) -> Column:
    """A cart's items (structs of p, q, n and pr as texts) cut and clamped to what is stored; all of them where ``most`` is None."""
    kept = F.filter(items, lambda x: F.coalesce(F.length(F.trim(x["p"])) > 0, F.lit(False)))
    return F.transform(
        kept if most is None else F.slice(kept, 1, most),
        lambda x: F.struct(
            F.substring(x["p"], 1, 64).alias("p"),
            F.least(F.greatest(F.coalesce(x["q"].try_cast("int"), F.lit(1)), F.lit(1)), F.lit(99)).alias("q"),
            F.substring(x["n"], 1, 120).alias("n"),
            x["pr"].try_cast("double").alias("pr"),
        ),
    )


def list_id(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^A-Za-z0-9_-]", ""), F.lit(""))


def unit_amount_text(price_: Column, amount: Column, packs: Column, per: str = "kg") -> Column:
    """"50.00 kr/kg" of a price for packs of an amount in grams."""
    value = F.try_divide(price_ * 1000, amount * packs)
    return F.when(value > 0, F.concat(F.format_string("%.2f", F.round(value, 2)), F.lit(f" kr/{per}")))


def oere(c: Column) -> Column:
    return F.round(c.try_cast("double") / 100, 2)


def producer(c: Column) -> Column:
    """The first word."""
    return F.nullif(F.split_part(F.trim(c), F.lit(" "), F.lit(1)), F.lit(""))


def local_month(ts: Column, zone: str = "Europe/Copenhagen") -> Column:
    """"2024-03": the month in a time zone of a time in UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def local_day(ts: Column, zone: str = "Europe/Copenhagen") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def local_day_of_month(ts: Column, zone: str = "Europe/Copenhagen") -> Column:
    return F.dayofmonth(F.from_utc_timestamp(ts, zone))


def leaflet_description(c: Column) -> Column:
    """A struct of kind, weight and kg_price of a leaflet's text such as "Skåret skinke, 150 g. 66,33 kr/kg"; empty texts where there are none."""
    weight, price_ = r"(?i)([0-9]+[.,]?[0-9]*)\s*(kg|g|l|ml|cl|dl|stk)", r"(?i)([0-9]+[.,]?[0-9]*)\s*(?:kr\s*)?/\s*(kg|g|l|ml|cl|dl)"
    has = c.rlike(weight)
    before = F.substring(c, F.lit(1), F.regexp_instr(c, F.lit(weight)) - 1)
    kind = F.when(has, F.trim(F.regexp_replace(F.regexp_replace(F.trim(before), "^[,| -]+", ""), "[,| -]+$", ""))).otherwise(F.trim(F.regexp_extract(c, r"^[^,.]+", 0)))
    return F.struct(
        F.coalesce(kind, F.lit("")).alias("kind"),
        F.when(has, F.concat(F.regexp_extract(c, weight, 1), F.lit(" "), F.lower(F.regexp_extract(c, weight, 2)))).otherwise("").alias("weight"),
        F.when(c.rlike(price_), F.concat(F.regexp_extract(c, price_, 1), F.lit(" kr/"), F.regexp_extract(c, price_, 2))).otherwise("").alias("kg_price"),
    )


def store_name_id(store: Column, normal_name: Column) -> Column:
    """An id of a name in a store; null for an empty name."""
    return F.when(F.length(normal_name) > 0, F.concat(F.lit("sname:"), store, F.lit(":"), F.substring(F.md5(normal_name), 1, 12)))


def saved_lists(lists: Column, most: int = 10) -> Column:
    """Saved lists (structs of id, name and items) as they are kept: those with items, ten at most, with safe ids and names."""
    named = F.transform(
        F.filter(lists, lambda x: F.size(compact_cart(x["items"])) > 0),
        lambda x: F.struct(
            F.coalesce(F.nullif(F.substring(list_id(F.coalesce(x["id"], F.lit(""))), 1, 40), F.lit("")), F.substring(F.md5(x["name"]), 1, 12)).alias("id"),
            F.coalesce(F.nullif(F.substring(F.trim(x["name"]), 1, 80), F.lit("")), F.lit("Liste")).alias("name"), compact_cart(x["items"]).alias("items"),
        ),
    )
    return F.slice(named, 1, most)
