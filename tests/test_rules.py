"""Rule tables against a plain reading of them, and their order."""

from __future__ import annotations

import random

from basketspark.operators import rules


def plain(row, table):
    i, text, brand = row
    text, brand = text or "", (brand or "").lower()
    for p, keyword, kind, unless, low, high, brands, but, result in sorted(table):
        padded = f" {text} "
        where = {"word": f" {keyword} " in padded, "end": f"{keyword} " in padded, "start": f" {keyword}" in padded}.get(kind, bool(keyword) and keyword in text) if keyword else True
        if where and not any(u in text for u in unless or ()) and (low is None or i >= low) and (high is None or i <= high) and (not brands or brand in brands) and brand not in (but or ()):
            return result, p
    return "other", None


def test_a_thousand_rules_in_order(spark):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choices("abæø", k=rng.randrange(1, n)))
    table = [
        (p, part(5) if rng.random() < 0.97 else part(3) + " " + part(3), rng.choice(["word", "end", "start", "any"]), rng.choice([None, None, [], [part(4)]]), *rng.choice([(None, None), (None, None), (100, 200), (None, 50)]),
         rng.choice([None, None, ["x", "y"]]), rng.choice([None, None, ["z"]]), rng.choice([None, f"c{p % 7}"]))
        for p in rng.sample(range(10_000), 1000)
    ]
    table += [(20_001, None, None, ["bb"], 280, 290, None, None, "by id"), (20_002, None, None, None, None, None, ["w"], None, "by brand")]
    rows = [(i, " ".join(part(6) for _ in range(rng.randrange(1, 4))), rng.choice(["X", "y", "z", "w", None])) for i in range(300)] + [(900, "", "w"), (901, None, None), (902, "c" * 2000, None)]
    rows = [(i, t, b) for i, t, b in rows]
    got = rules.by_rules(spark.createDataFrame(rows, "id long, text string, brand string"), spark.createDataFrame(table, rules.RULE), default="other").collect()
    assert {r.id: (r.result, r.rule) for r in got} == {r[0]: plain(r, table) for r in rows}
    assert len({r.rule for r in got}) > 15


def test_the_first_rule_wins_whatever_is_longer(spark):
    """Compounds by their end; an exception before the rule; a brand that is left out."""
    table = [(1, "ispinde", "end", None, None, None, None, None, "ice"), (2, "is", "word", ["te"], None, None, None, None, "ice"), (3, "brød", "end", None, None, None, None, ["deli"], "bread"), (4, "tobak", "any", None, None, None, None, None, None), (5, "te", "end", None, None, None, None, None, "tea")]
    rows = [(1, "rugbrød", "a"), (2, "is te", "a"), (3, "brødkniv", "a"), (4, "rullebrød", "Deli"), (5, "rulletobak te", "a"), (6, "vaniljeispinde", "a"), (7, "is", "a")]
    got = {r.id: (r.result, r.rule) for r in rules.by_rules(spark.createDataFrame(rows, "id long, text string, brand string"), spark.createDataFrame(table, rules.RULE), default="other").collect()}
    assert got == {1: ("bread", 3), 2: ("tea", 5), 3: ("other", None), 4: ("other", None), 5: (None, 4), 6: ("ice", 1), 7: ("ice", 2)}
