"""Listing, promotion and search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import ready
from ..functions import text
from ..operators import dictionary, listing, rules, search
from . import mapping as m
from .parsing import NAMES_SQL, NORMAL_SQL
from .registry import query

_FILTER = "is_sale AND eff_price >= 850 AND eff_price <= 1500 AND (weight_g IS NULL OR weight_g <= 400) AND organic"


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cards(spark, sf_dir).filter(listing.conditions(on_sale=True, price=(850, 1500), weight=(None, 400), flags=("organic",)))


@query(f"WITH {m.C} SELECT id, eff_price, weight_g FROM cards WHERE {_FILTER} ORDER BY eff_price, id LIMIT 60 OFFSET 0")
def listing_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(_filtered(spark, sf_dir), "price-asc", 1).select("id", "eff_price", "weight_g")


@query(f"WITH {m.C} SELECT id, row_number() OVER (ORDER BY eff_price DESC, id) AS position FROM cards QUALIFY position BETWEEN 61 AND 120")
def listing_price_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.page(m.cards(spark, sf_dir), "price-desc", 2)
    return rows.select("id", (F.row_number().over(Window.orderBy(*listing.order("price-desc"))) + 60).cast("long").alias("position"))


@query(f"WITH {m.C} SELECT id, eff_price, weight_g FROM cards ORDER BY eff_price / CASE WHEN weight_g > 0 THEN weight_g END NULLS LAST, id LIMIT 60")
def listing_kgprice_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(m.cards(spark, sf_dir), "kg-price-asc", 1).select("id", "eff_price", "weight_g")


@query(f"WITH {m.C} SELECT id, title FROM cards ORDER BY lower(title), id LIMIT 60 OFFSET 60")
def listing_name_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(m.cards(spark, sf_dir), "name-asc", 2).select("id", "title")


@query(f"WITH {m.C} SELECT category, count(*) AS total, greatest(CAST(ceil(count(*) / 60.0) AS BIGINT), 1) AS pages FROM cards GROUP BY category")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page_counts(m.cards(spark, sf_dir), "category")


@query(f"WITH {m.C} SELECT DISTINCT category, subcategory FROM cards")
def distinct_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cards(spark, sf_dir).select("category", "subcategory").distinct()


@query(f"WITH {m.C} SELECT id FROM cards WHERE NOT regexp_matches(lower(concat_ws(' ', title, category)), 'hot|cold') AND NOT regexp_matches(lower(concat_ws(' ', title, category)), 'bolt') AND NOT contains('img' || id % 50, 'img7')")
def allowed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.cards(spark, sf_dir).withColumn("image", F.concat(F.lit("img"), F.col("id") % 50))
    return listing.allowed(rows, "hot|cold", "bolt", "img7").select("id")


@query(f"WITH {m.OFFERS} SELECT product_id, count(*) AS stores FROM offers GROUP BY product_id HAVING bool_or(store IN (2, 5))")
def store_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = m.offers(spark, sf_dir).groupBy("product_id").agg(F.collect_set(F.col("store").cast("string")).alias("stores"))
    return cards.filter(listing.available(F.col("stores"), ["2", "5"])).select("product_id", F.size("stores").cast("long").alias("stores"))


@query(f"""WITH {m.OFFERS}, o AS (SELECT *, store = product_id % 14 AS is_anchor FROM offers WHERE store IN (1, 3, 5, 7, 9))
SELECT product_id, store, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY is_anchor DESC, price, store) AS nth FROM o) WHERE nth = 1""")
def promotion_active_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = m.offers(spark, sf_dir).withColumn("is_anchor", F.col("store") == F.col("product_id") % 14)
    return listing.promoted(offers, (1, 3, 5, 7, 9)).select("product_id", "store", "price")


@query(f"""WITH {m.C}, {m.E}, c AS (SELECT *, price - eff_price AS rebate, id % 17 AS staple FROM cards), pop AS (SELECT CAST(pid AS BIGINT) AS id, count(*) AS count FROM ev GROUP BY 1),
s1 AS (SELECT 1 AS section, row_number() OVER (ORDER BY rebate DESC, id) AS position, id FROM c WHERE is_sale QUALIFY position <= 60),
s2 AS (SELECT 2 AS section, row_number() OVER (ORDER BY count DESC, id) AS position, id FROM c JOIN pop USING (id) WHERE count >= 2 AND id NOT IN (SELECT id FROM s1) QUALIFY position <= 60),
s3 AS (SELECT 3 AS section, row_number() OVER (ORDER BY staple DESC, id) AS position, id FROM c WHERE id NOT IN (SELECT id FROM s1 UNION SELECT id FROM s2) QUALIFY position <= 20)
SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3""")
def home_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = m.cards(spark, sf_dir).withColumn("rebate", F.col("price") - F.col("eff_price")).withColumn("staple", F.col("id") % 17)
    popular = m.events(spark, sf_dir).groupBy(F.col("pid").cast("long").alias("id")).agg(F.count("*").alias("count"))
    return listing.sections(cards, popular)


@query(f"WITH {NAMES_SQL}, {NORMAL_SQL} SELECT DISTINCT token, id FROM (SELECT id, unnest(string_split(name, ' ')) AS token FROM normal) WHERE length(token) >= 2")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_index(m.documents(spark, sf_dir))


@query(f"""WITH {NAMES_SQL}, {NORMAL_SQL}, t AS (SELECT DISTINCT token, id FROM (SELECT id, unnest(string_split(name, ' ')) AS token FROM normal))
SELECT id FROM t WHERE token IN ('the', 'inea', 'ered') GROUP BY id HAVING count(DISTINCT token) = 3""")
def and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.and_search(search.token_index(m.documents(spark, sf_dir)), ["the", "inea", "ered"])


_TERM = "(starts_with(f, '{t}') OR (ends_with(f, '{t}') AND length(f) - {n} >= 3) OR (length(f) >= 4 AND starts_with('{t}', f)))"
_TOKENS = f"{NAMES_SQL}, {NORMAL_SQL}, t AS (SELECT DISTINCT id, token, replace(replace(token, 'æ', 'ae'), 'ø', 'oe') AS f FROM (SELECT id, unnest(string_split(name, ' ')) AS token FROM normal) WHERE length(token) >= 1)"


@query(f"WITH {_TOKENS} SELECT id FROM t GROUP BY id HAVING bool_or({_TERM.format(t='inger', n=5)}) AND bool_or({_TERM.format(t='heat', n=4)})")
def term_prefix_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.documents(spark, sf_dir).withColumn("tokens", text.tokens(text.normalized(F.col("name"))))
    return rows.filter(search.matches(F.col("tokens"), ["inger", "heat"])).select("id")


def _best(t: str) -> str:
    return f"max(CASE WHEN token = '{t}' THEN 100 WHEN starts_with(token, '{t}') THEN 70 WHEN ends_with(token, '{t}') THEN 50 ELSE 0 END)"


@query(f"""WITH {_TOKENS}, s AS (SELECT id, {_best('inger')} + {_best('the')} AS n FROM t GROUP BY id)
SELECT id, CAST((coalesce(n, 0) + CASE WHEN lang = 'en' THEN 40 ELSE 0 END) * 1000 - least(length(name), 999) AS INT) AS relevance FROM names LEFT JOIN s USING (id)""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.documents(spark, sf_dir).withColumn("tokens", text.tokens(text.normalized(F.col("name"))))
    return rows.select("id", search.relevance(F.col("tokens"), F.col("name"), ["inger", "the"], F.col("lang") == "en").alias("relevance"))


@query(f"""WITH {m.C}, pool AS (SELECT id, name FROM cards WHERE starts_with(name, 's') ORDER BY id LIMIT 60)
SELECT name AS key, min(id) AS id FROM pool GROUP BY name ORDER BY length(name), name LIMIT 8""")
def autocomplete_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggestions(m.cards(spark, sf_dir), "s")


def _like(t: str) -> str:
    return f"(name LIKE '{t}%' OR name LIKE '% {t}%' OR name LIKE '%{t}' OR name LIKE '%{t} %' OR ({len(t)} >= 5 AND name LIKE '%{t[:5]}%'))"


@query(f"WITH {m.C} SELECT id, name FROM cards WHERE {_like('small')} AND {_like('ring')}")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cards(spark, sf_dir).filter(search.like_any(F.col("name"), ["small", "ring"])).select("id", "name")


@query(f"WITH {m.C} SELECT id, name FROM cards WHERE name LIKE 'wid%' OR name LIKE '% wid%'")
def prefix_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.cards(spark, sf_dir).select("id", "name")
    return search.widened(rows, rows.filter(F.col("name").contains("widgeon")), "widgeon")


@query(f"WITH {m.C}, k AS (SELECT DISTINCT keyword, category FROM (SELECT category, unnest(string_split(name || ' ' || lower(brand || category), ' ')) AS keyword FROM cards)) SELECT keyword, min(category) AS category FROM k GROUP BY keyword HAVING count(DISTINCT category) = 1")
def category_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.cards(spark, sf_dir).select("category", F.explode(F.split(F.concat("name", F.lit(" "), F.lower(F.concat("brand", "category"))), " ")).alias("keyword"))
    return search.category_prior(rows)


#: Indel similarity in SQL: the last row of the table of common subsequences, by a recursive fold over characters.
INDEL_SQL = """
lcs(a, b, i, row) AS (
    SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM pairs
    UNION ALL
    SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0])
    FROM lcs WHERE i < length(a)
), ratios AS (SELECT a, b, 2.0 * row[length(b) + 1] / (length(a) + length(b)) AS ratio FROM lcs WHERE i = length(a))"""


@query(f"""WITH RECURSIVE {m.C}, vocab AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS token FROM cards), pairs AS (SELECT token AS a, 'gizmos' AS b FROM vocab WHERE length(token) >= 4 AND abs(length(token) - 6) <= 3), {INDEL_SQL},
hit AS (SELECT a FROM ratios WHERE round(ratio, 6) >= 0.82) SELECT DISTINCT id FROM (SELECT id, unnest(string_split(name, ' ')) AS token FROM cards) WHERE token IN (SELECT a FROM hit)""")
def fuzzy_fallback_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_search(search.token_index(m.cards(spark, sf_dir)), ["gizmos"])


def _dictionary(spark: SparkSession, sf_dir: str, *layouts: str) -> dictionary.Dictionary:
    """The stored dictionary of all documents' names, written for this query."""
    ready(spark)
    rows = m.documents(spark, sf_dir).select("id", text.tokens(text.normalized(F.col("name"))).alias("tokens"))
    return dictionary.build(rows, f"{spark.sparkContext.getCheckpointDir()}/dictionary-{uuid.uuid4().hex}", layouts=layouts)


@query(f"WITH {_TOKENS} SELECT id FROM t GROUP BY id HAVING bool_or({_TERM.format(t='eder', n=4)}) AND bool_or({_TERM.format(t='thea', n=4)})")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir, "beginnings", "endings").search(["eder", "thea"])


def _like_word(t: str) -> str:
    return f"(starts_with(token, '{t}') OR ends_with(token, '{t}')" + (f" OR contains(token, '{t[:5]}'))" if len(t) >= 5 else ")")


@query(f"WITH {_TOKENS} SELECT id FROM t GROUP BY id HAVING bool_or({_like_word('heatin')}) AND bool_or({_like_word('ered')})")
def dictionary_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir, "beginnings", "endings", "grams").search(["heatin", "ered"], "containing")


@query(f"""WITH RECURSIVE {_TOKENS}, pairs AS (SELECT DISTINCT token AS a, 'reading' AS b FROM t WHERE length(token) BETWEEN 4 AND 10), {INDEL_SQL}
SELECT DISTINCT id FROM t WHERE token IN (SELECT a FROM ratios WHERE round(ratio, 6) >= 0.82)""")
def dictionary_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir, "pieces").search(["reading"], "near")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS nth FROM pages)
SELECT page_id, href, CAST(min(nth) AS INT) AS position FROM l GROUP BY 1, 2""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import readers

    return readers.html_links(m.load(spark, sf_dir, "pages"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import readers

    return readers.html_cards(m.load(spark, sf_dir, "pages"))


_RULES = """words AS (SELECT DISTINCT unnest([split_part(lower(p_name), ' ', 1), split_part(lower(p_name), ' ', 2)]) AS w FROM part), numbered AS (SELECT row_number() OVER (ORDER BY w) AS priority, w FROM words),
r AS (SELECT priority, w, CASE priority % 3 WHEN 0 THEN right(w, 3) WHEN 1 THEN w ELSE left(w, 2) END AS keyword, priority % 3 AS kind, CASE WHEN priority % 4 = 0 THEN 100 END AS low, priority % 5 = 0 AS not_11 FROM numbered),
hits AS (SELECT p_partkey AS id, priority, CASE WHEN priority % 7 > 0 THEN w END AS result FROM part JOIN r ON (low IS NULL OR p_partkey >= low) AND NOT (not_11 AND p_brand = 'Brand#11')
    AND CASE kind WHEN 0 THEN contains(lower(p_name) || ' ', keyword || ' ') WHEN 1 THEN contains(' ' || lower(p_name) || ' ', ' ' || keyword || ' ') ELSE contains(' ' || lower(p_name), ' ' || keyword) END)"""


@query(f"WITH {_RULES} SELECT p_partkey AS id, CASE WHEN min(priority) IS NULL THEN 'other' ELSE any_value(result ORDER BY priority) END AS result, min(priority)::INT AS rule FROM part LEFT JOIN hits ON id = p_partkey GROUP BY p_partkey".replace("any_value(result ORDER BY priority)", "first(result ORDER BY priority)"))
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of the words of all names: ends, whole words and beginnings, with ids and brands left out."""
    part = m.load(spark, sf_dir, "part")
    words = part.select(F.explode(F.slice(F.split(F.lower("p_name"), " "), 1, 2)).alias("w")).distinct()
    numbered = words.withColumn("priority", F.row_number().over(Window.orderBy("w")))  # a few dozen words
    kind, texts = F.col("priority") % 3, F.array().cast("array<string>")
    table = numbered.select(
        "priority", F.when(kind == 0, F.right("w", F.lit(3))).when(kind == 1, F.col("w")).otherwise(F.left("w", F.lit(2))).alias("keyword"), F.when(kind == 0, "end").when(kind == 1, "word").otherwise("start").alias("kind"),
        F.lit(None).cast("array<string>").alias("unless"), F.when(F.col("priority") % 4 == 0, 100).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("array<string>").alias("brands"),
        F.when(F.col("priority") % 5 == 0, F.array(F.lit("brand#11"))).otherwise(texts).alias("but_brands"), F.when(F.col("priority") % 7 > 0, F.col("w")).alias("result"),
    )
    rows = part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text"), F.col("p_brand").alias("brand"))
    return rules.by_rules(rows, table, default="other").select("id", "result", "rule")
