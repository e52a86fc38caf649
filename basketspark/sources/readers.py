"""Feeds in XML and JSON, HTML pages, snapshots and paged tables as DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import parse

#: A raw offer, as every store's reader returns it.
OFFER = "store string, source_kind string, name string, brand string, net_weight string, unit_price_text string, price double, normal_price string, sku string, image_url string, image_hash string, on_sale boolean, multi_deal string"
XML_PRODUCT = "id string, title string, price string, sale_price string, description string, brand string, imageLink string, product_type string, unit_pricing_measure string"


def xml_feed(spark: SparkSession, path: str, restricted: str = "tobak|alkohol") -> DataFrame:
    """A catalogue of <product> elements: rows without id or title, free or restricted ones go; a price per kg is derived."""
    rows = spark.read.format("xml").option("rowTag", "product").schema(XML_PRODUCT).load(path)
    rows = rows.withColumns({"list_price": parse.price(F.col("price")), "sale": F.nullif(parse.price(F.col("sale_price")), F.lit(0.0)), "weight_g": parse.weight_grams(F.col("unit_pricing_measure"))})
    eff = parse.effective_price(F.col("list_price"), F.col("sale"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("title").isNotNull() & (eff > 0) & ~F.lower(F.coalesce("product_type", F.lit(""))).rlike(restricted))
    return rows.withColumn("price_per_kg", parse.price_per_kg(eff, F.col("weight_g")))


def search_dump(spark: SparkSession, path: str, stores: Sequence[str]) -> DataFrame:
    """A search index's hits with prices by store (in hundredths): the first reference store that has a price counts; an object once."""
    schema = "objectID string, name string, brand string, units double, unitsOfMeasure string, storeData map<string, struct<price: long, before: long, offer: boolean>>, images array<string>"
    rows = spark.read.schema(schema).json(path)
    known = F.map_filter("storeData", lambda k, v: v["price"] > 0)
    ordered = F.array_compact(F.array(*(F.try_element_at(known, F.lit(s)) for s in stores)))
    picked = F.coalesce(F.try_element_at(ordered, F.lit(1)), F.try_element_at(F.map_values(known), F.lit(1)))
    rows = rows.select("*", picked.alias("x")).filter("x IS NOT NULL")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("objectID").orderBy("name", "x"))).filter("nth = 1")
    return rows.select("objectID", "name", "brand", parse.oere(F.col("x.price")).alias("price"), F.when(F.col("x.before") > F.col("x.price"), parse.oere(F.col("x.before"))).alias("normal_price"), F.coalesce("x.offer", F.lit(False)).alias("on_sale"), F.element_at("images", 1).alias("image_url"))


def leaflet_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offers of leaflets; one for each catalogue and heading, the first that was read by id."""
    rows = spark.read.schema("id string, catalog_id string, heading string, description string, pricing struct<price: double, pre_price: double>, quantity string").json(path)
    key = F.concat_ws("|", "catalog_id", F.lower("heading"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    rows = rows.withColumn("nth", first).filter("nth = 1 AND heading IS NOT NULL")
    return rows.select("id", "catalog_id", F.col("heading").alias("name"), "pricing.price", F.col("pricing.pre_price").alias("normal_price"), (F.col("pricing.pre_price") > F.col("pricing.price")).alias("on_sale"), parse.weight_grams(F.col("quantity")).alias("weight_g"))


def pool_products(pages: DataFrame, text_col: str, fields: Sequence[str]) -> DataFrame:
    """The objects of a pool that have all the fields, with the values their indices lead to."""
    pool = F.from_json(F.col(text_col), "array<string>")
    rows = pages.select("*", pool.alias("pool")).select("*", F.posexplode("pool").alias("at", "item"))
    rows = rows.filter(F.col("item").startswith("{")).select("*", F.from_json("item", "map<string,int>").alias("refs"))
    have = functools.reduce(lambda a, b: a & b, (F.map_contains_key("refs", f) for f in fields))
    return rows.filter(have).select("page_id", *(F.try_element_at(F.col("pool"), F.try_element_at("refs", F.lit(f)) + 1).alias(f) for f in fields))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href): each target of a page's links once, where it is first."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("at", "href"))
    return rows.groupBy("page_id", "href").agg(F.min("at").alias("position"))


def html_cards(pages: DataFrame) -> DataFrame:
    """Title, first heading and number of paragraphs of a page."""
    first = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return pages.select("page_id", first(r"<title>([^<]*)</title>").alias("title"), first(r"<h1>([^<]*)</h1>").alias("heading"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


def json_ld_recipes(pages: DataFrame, depth: int = 3) -> DataFrame:
    """The first Recipe of a page's JSON-LD, on top, in lists or in @graph (to a depth): title, source, image, servings, minutes and ingredients.

    Values that may be a text, an object or a list of either are read in each form.
    """
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]+type=["\']application/ld\+json["\'][^>]*>(.*?)</script>"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(blocks).alias("block", "text")).select("page_id", F.array("block").alias("place"), F.try_parse_json("text").alias("node")).filter("node IS NOT NULL")
    get = lambda path, kind="string": F.try_variant_get("node", path, kind)
    found = rows
    for _ in range(depth):
        inside = F.coalesce(get("$", "array<variant>"), get('$["@graph"]', "array<variant>"), F.when(get('$["@graph"]', "variant").isNotNull(), F.array(get('$["@graph"]', "variant"))))
        rows = rows.select("page_id", "place", F.posexplode(inside).alias("at", "node")).select("page_id", F.array_append("place", F.col("at")).alias("place"), "node")
        found = found.unionByName(rows)
    texts = lambda path: F.coalesce(get(path, "array<string>"), F.when(get(path).isNotNull(), F.array(get(path))))
    kinds = texts('$["@type"]')
    first = lambda path, *inner: F.coalesce(*(get(p, "string") for p in (*(f"{path}[0].{i}" for i in inner), f"{path}[0]", *(f"{path}.{i}" for i in inner), path)))
    lines = F.coalesce(texts("$.recipeIngredient"), texts("$.ingredients"))
    recipes = found.filter(F.coalesce(F.array_contains(kinds, "Recipe"), F.lit(False))).select(
        "page_id", "place", F.coalesce(F.nullif(F.trim(get("$.name")), F.lit("")), F.lit("Unavngivet opskrift")).alias("name"), F.trim(F.coalesce(first("$.author", "name"), F.lit(""))).alias("source"),
        F.coalesce(first("$.image", "url"), F.lit("")).alias("image"), F.nullif(F.regexp_extract(F.coalesce(first("$.recipeYield"), F.lit("")), "[0-9]+", 0), F.lit("")).try_cast("int").alias("servings"),
        parse.duration_minutes(get("$.totalTime")).alias("minutes"), F.filter(F.transform(F.array_compact(F.coalesce(lines, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != "").alias("ingredients"),
    )
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("place"))
    return recipes.withColumn("nth", nth).filter("nth = 1").drop("nth", "place")


def after(rows: DataFrame, key: str, last: int, size: int = 1000) -> DataFrame:
    """The next page of a table by key: rows beyond ``last``, ``size`` at most."""
    return rows.filter(F.col(key) > last).orderBy(key).limit(size)


def all_pages(rows: DataFrame, key: str, size: int = 1000) -> Iterator[DataFrame]:
    """A table page by page, in order of a key, until none is left; for consumers that take a page at a time."""
    last = rows.agg(F.min(key)).first()[0]
    last = None if last is None else last - 1
    while last is not None:
        page = after(rows, key, last, size)
        last = page.agg(F.max(key)).first()[0]
        if last is not None:
            yield page


def fresh_snapshot(spark: SparkSession, path: str, minutes: int, now: Column) -> DataFrame:
    """The rows of JSON snapshot files that are young enough."""
    rows = spark.read.json(path).select("*", F.col("_metadata.file_modification_time").alias("read_at"))
    return rows.filter(F.col("read_at") >= now - F.make_interval(mins=F.lit(minutes))).drop("read_at")


def all_stores(readers: dict[str, Callable[[], DataFrame]], schema: str = OFFER) -> tuple[DataFrame, dict[str, str]]:
    """The offers of all stores that can be read, and what went wrong with the others.

    Each store's rows are checkpointed, so that a feed that fails while it is read fails alone.
    """
    spark = SparkSession.active()
    parts, failed = [spark.createDataFrame([], schema)], {}
    for store, read in readers.items():
        try:
            parts.append(checkpointed(read().select(*spark.createDataFrame([], schema).columns)))
        except Exception as e:  # a store's feed may be missing or of another form
            failed[store] = str(e).splitlines()[0]
    return functools.reduce(DataFrame.unionByName, parts), failed


def first_source(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read and has rows."""
    last: Exception | None = None
    for read in sources:
        try:
            rows = read()
            if not rows.isEmpty():
                return rows
        except Exception as e:
            last = e
    raise LookupError("no source has rows") from last


def ingestible(offers: DataFrame, unwanted: dict[str, str] | None = None, no_ean: Sequence[str] = ()) -> DataFrame:
    """Offers with a positive price and a category; a store's unwanted brand goes, and the EANs of stores whose numbers are none are blanked."""
    rows = offers.filter((F.col("price") > 0) & F.col("category").isNotNull())
    for store, brand in (unwanted or {}).items():
        rows = rows.filter(~F.coalesce((F.col("store") == store) & (F.lower("brand") == brand.lower()), F.lit(False)))
    return rows.withColumn("ean", F.when(~F.col("store").isin(*no_ean), F.col("ean")).cast("string")) if no_ean and "ean" in rows.columns else rows
