"""Names and queries as comparable text, terms and rules, as column expressions."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations and spellings that are written out as whole words.
ABBREVIATIONS = {
    "sc": "sour cream", "hk": "hakket", "fuldk": "fuldkorn", "eks": "ekstra", "kyl": "kylling", "kart": "kartoffel", "champ": "champignon", "sdj": "sønderjysk", "øko": "okologisk",
    "vanille": "vanilje", "vanilla": "vanilje", "smørbart": "smørbar", "smrbar": "smørbar",
    "hyldebl": "hyldeblomst", "hindb": "hindbaer", "jordb": "jordbaer", "peberm": "pebermynte", "chokol": "chokolade", "vanilj": "vanilje",
}
#: What is taken out of names wherever it stands.
NOISE = ("%", " eko", " bio", " a/s", " i/s")
#: Words that say nothing about the product.
GENERIC = ("stk", "pakke", "pose", "flaske", "the", "and", "med", "uden", "eller")
LETTER = r"[\p{L}\p{N}_]"


def whole(pattern: str) -> str:
    """The pattern where no letter or digit stands beside it."""
    return f"(?<!{LETTER})(?:{pattern})(?!{LETTER})"


#: The five flags and how they are written, on lower-case text.
VARIANTS = {
    "organic": rf"(?<!{LETTER})økolog|{whole('øko')}|{whole('organic')}",
    "lactose_free": rf"laktosefri|laktose fri|lactose[ -]free|lactofri|lacto-free|lactofree|{whole('lacto')}",
    "sugar_free": rf"sukkerfri|sukker fri|sugar[ -]free|{whole('zero')}|no sugar|uden sukker|(?<!{LETTER})nul suk|0% sugar",
    "gluten_free": "glutenfri|gluten fri|gluten[ -]free|uden gluten",
    "alcohol_free": rf"alkoholfri|alkohol fri|alcohol[ -]free|(?<!{LETTER})nul ?%|(?<!{LETTER})0[,.]0 ?%",
}
NOT_ORGANIC = rf"(?<!{LETTER})ikke\s+øko"
#: Kinds of meat and fish in normalized names.
MEATS = {
    "okse": rf"(?<!{LETTER})okse", "gris": rf"{whole('gris')}|(?<!{LETTER})grise|{whole('svin')}|(?<!{LETTER})svine", "kylling": rf"(?<!{LETTER})kylling", "høns": rf"(?<!{LETTER})høns",
    "kalv": rf"{whole('kalv')}|(?<!{LETTER})kalve", "lam": rf"{whole('lam')}|(?<!{LETTER})lamme(?!fjord)", "skinke": rf"(?<!{LETTER})skinke", "kalkun": rf"(?<!{LETTER})kalkun",
    "tun": rf"{whole('tun')}|(?<!{LETTER})tunfisk", "laks": rf"(?<!{LETTER})laks",
}
#: Forms of a product, and kinds of milk and cream in order.
FORMS = ("pudding", "budding", "mousse", "skyr", "kefir", "yoghurt", "yogurt", "drik", "shake")
DAIRY = ("mini", "let", "skummet", "sod", "piske", "kærne", "kær")


class Forms(NamedTuple):
    """Characters that stand for others, by how many those are: one (then none), or several."""

    single: str
    plain: str
    several: dict[str, str]


#: Syllables of two or three letters, which follow a rule: the first of them, and their first, middle and last letters.
SYLLABLES, INITIAL, MIDDLE, FINAL = 0xAC00, *("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@functools.cache
def compatibility_forms() -> Forms:
    """All characters but those syllables that compatibility decomposition without marks changes, as it is known to Python."""
    one, none, several = {}, [], {}
    for c in map(chr, itertools.chain(range(0x80, SYLLABLES), range(SYLLABLES + 11172, 0xD800), range(0xE000, 0x30000))):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if c.lower() != c or base == c:
            continue
        if len(base) > 1:
            several[c] = base
        elif base:
            one[c] = base
        else:
            none.append(c)
    return Forms("".join(one) + "".join(none), "".join(one.values()), several)


@functools.cache
def _class_of(chars: str) -> str:
    """A class of regular expressions that has these characters."""
    runs: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a < b else rf"\x{{{a:X}}}" for a, b in runs) + "]"


def _spelled(x: Column) -> Column:
    """Characters that stand for several, written out one by one."""
    several, end = compatibility_forms().several, "\x01"
    table = end + end.join(c + base for c, base in several.items()) + end
    code = lambda ch: F.ascii(ch) - SYLLABLES
    letter = lambda letters, i: F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))

    def one(ch: Column) -> Column:
        last = F.pmod(code(ch), F.lit(28))
        syllable = F.concat(letter(INITIAL, F.floor(code(ch) / 588)), letter(MIDDLE, F.floor(F.pmod(code(ch), F.lit(588)) / 28)), F.when(last > 0, letter(FINAL, last - 1)).otherwise(""))
        known = F.split_part(F.split_part(F.lit(table), F.concat(F.lit(end), ch), F.lit(-1)), F.lit(end), F.lit(1))
        return F.when(ch.between(chr(SYLLABLES), chr(SYLLABLES + 11171)), syllable).when(ch.rlike(_class_of("".join(several))), known).otherwise(ch)

    return F.array_join(F.transform(F.split(x, ""), one), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value found once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_marks(c: Column) -> Column:
    """Lower-case text with é as e, å as a and ½ as 1⁄2; letters of their own such as æ and ø stay."""
    forms = compatibility_forms()
    several = _class_of("".join(forms.several) + chr(SYLLABLES) + chr(SYLLABLES + 1))[:-1] + rf"\x{{{SYLLABLES:X}}}-\x{{{SYLLABLES + 11171:X}}}]"
    # patterns are tried on texts only that have letters of more than one byte, and the long class on those that have more than common ones
    wide = lambda x: F.octet_length(x) > F.char_length(x)
    plain = lambda x: F.when(wide(x), F.translate(x, forms.single, forms.plain)).otherwise(x)
    uncommon = _class_of("".join(x for x in forms.several if x < "\u0180"))[:-1] + r"\x{180}-\x{10FFFF}]"
    return let(let(c, plain), lambda x: F.when(wide(x) & x.rlike(uncommon), F.when(x.rlike(several), _spelled(x)).otherwise(x)).otherwise(x))


def _written_out(x: Column) -> Column:
    long_ = x
    for short, full in ABBREVIATIONS.items():
        before = "(?<!f )" if short == "eks" else ""  # "for eksempel"
        long_ = F.regexp_replace(long_, before + whole(short), full)
    # a coarse pattern first, as the texts that have one are few: by first letters, and nothing of ASCII beside
    first = {c: "|".join(w[1:] for w in ABBREVIATIONS if w[0] == c) for c in sorted({w[0] for w in ABBREVIATIONS})}
    some = "|".join(f"{c}(?:{rest})" for c, rest in first.items())
    return F.when(x.rlike(rf"(?=[{''.join(first)}])(?<![a-z0-9])(?:{some})(?![a-z0-9])"), long_).otherwise(x)


def normalized(c: Column) -> Column:
    """Names as comparable text: lower case, without marks, abbreviations written out, without noise; empty for none."""
    x = without_marks(F.lower(F.coalesce(F.when(c != "nan", c), F.lit(""))))
    for old, new in (("&", "and"), ("+", "and"), (",", " "), ("'", ""), ("’", ""), (".", " ")):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = let(x, _written_out)
    for word in NOISE:
        x = F.replace(x, F.lit(word), F.lit(""))
    x = let(x, lambda y: F.when(y.contains("okologisk"), F.regexp_replace(y, whole("okologisk"), "")).otherwise(y))
    return F.trim(F.regexp_replace(x, r"[/\s\p{Z}\x1C-\x1F\x85]+", " "))


def folded(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("oe"))


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct tokens of normalized text, in order of appearance."""
    words = F.array_distinct(F.split(c, " "))
    return F.array_remove(words, "") if least == 1 else F.filter(words, lambda t: F.length(t) >= least)


def content_words(c: Column) -> Column:
    words = F.filter(F.split(c, " "), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]"))
    return F.array_distinct(F.array_except(words, F.array(*(F.lit(w) for w in GENERIC))))


def term_matches(token: Column, term: str) -> Column:
    """Equal or a prefix; a suffix if something of three letters is before it; or a prefix the other way round."""
    t = term.lower().replace("æ", "ae").replace("ø", "oe")
    token = folded(token)
    return (
        token.startswith(t)
        | (token.endswith(t) & (F.length(token) - len(t) >= 3))
        | ((F.length(token) >= 4) & F.lit(t).startswith(token))
    )


def percents(c: Column) -> Column:
    """Distinct percentages in a text, sorted; "45+" of cheese counts."""
    signed = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.,][0-9]+)?)\s*%"), F.lit(1))
    plus = F.regexp_extract_all(c, F.lit(r"(?<![0-9,.])([0-9]{2})\s*\+"), F.lit(1))
    found = F.transform(F.concat(signed, plus), lambda x: F.round(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), 1))
    return F.array_sort(F.array_distinct(found))


def variant_flags(c: Column) -> dict[str, Column]:
    text = F.lower(F.coalesce(c, F.lit("")))
    out = {k: text.rlike(p) for k, p in VARIANTS.items()}
    out["organic"] = out["organic"] & ~text.rlike(NOT_ORGANIC)
    return out


def meats(c: Column) -> Column:
    return let(normalized(c), lambda x: flagged(x, MEATS))


def dairy(normal: Column) -> Column:
    """The first kind of milk or cream that is part of a normalized name, or null."""
    return F.coalesce(*(F.when(normal.contains(d), F.lit(d)) for d in DAIRY))


def private_label(brand: Column, title: Column, brands: Sequence[str], beginnings: Sequence[str]) -> Column:
    """Whether a store's own brand: the brand is one, or brand or title begin like one."""
    b, t = F.lower(F.trim(F.coalesce(brand, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return functools.reduce(lambda x, p: x | b.startswith(p) | t.startswith(p), beginnings, b.isin(*brands) if brands else F.lit(False))


def first_rule(c: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The name of the first rule whose pattern is found; rules in order."""
    out = None
    for pattern, name in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def flagged(c: Column, patterns: Mapping[str, str]) -> Column:
    """The names of all patterns found, in their order."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in patterns.items())))


def automaton(words: Sequence[str]) -> Callable[[str], dict[int, int]]:
    """Finds all words of a text in one pass: for each, by its place in ``words``, where it is first free on one side."""
    trie = ahocorasick.Automaton()
    for i, w in enumerate(words):
        trie.add_word(w, i)
    if not words:
        return lambda text: {}
    trie.make_automaton()
    inside = re.compile("[a-zæøå]")

    def free_places(text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for end, i in trie.iter(text):
            start = end + 1 - len(words[i])
            if i not in out and not (start and inside.match(text, start - 1) and inside.match(text, end + 1)):
                out[i] = start
        return out

    return free_places


def keywords(c: Column, lexicon: Mapping[str, Sequence[str]] | Sequence[str], blockers: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """What the words of a lexicon stand for, sorted: of a text's parts the longest words first, each taken out before shorter ones are looked for.

    A word counts where it stands free on one side at least; what is taken out may free
    another one, so this goes on until nothing is found. ``blockers`` are taken out before,
    and ``suffixes`` from the ends of longer words. One automaton has the whole lexicon, so a
    text's time grows with the words found in it and not with those of the lexicon.
    """
    means = {w: [w] for w in lexicon} if not isinstance(lexicon, Mapping) else {w: [v] if isinstance(v, str) else list(v) for w, v in lexicon.items()}
    words = sorted(filter(str.strip, means), key=lambda w: -len(w))
    names = [means[w] for w in words]
    letter = "[a-zæøå]"
    blocked = re.compile("|".join(map(re.escape, filter(None, blockers))) or "(?!)")
    ends = re.compile(rf"(?<={letter})(?:{'|'.join(map(re.escape, sorted(suffixes, key=len, reverse=True)))})\b" if suffixes else "(?!)")

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        free_places = automaton(words)

        def found(text: str) -> list[str]:
            out: set[str] = set()
            text = ends.sub(" ", blocked.sub(" ", text))
            places, last = free_places(text), -1
            while places:
                # the next shorter one; after the shortest, the longest again
                at = min((w for w in places if w > last), default=min(places))
                out.update(names[at])
                text, last = f"{text[: places[at]]} {text[places[at] + len(words[at]) :]}", at
                places = free_places(text)
            return sorted(out)

        for texts in batches:
            known = {t: found(t) for t in texts.dropna().unique()}
            yield texts.map(lambda t: known.get(t, []))

    return scan(F.lower(c))


def search_keywords(c: Column, image_url: Column, lexicon: Mapping[str, Sequence[str] | str], **kind: Sequence[str]) -> Column:
    """What a text and its image's address say by a lexicon, with all words of the lexicon that mean the same; as one text."""
    means = {w: [v] if isinstance(v, str) else list(v) for w, v in lexicon.items()}
    words = {n: " ".join(sorted({n, *(w for w, ns in means.items() if n in ns)})) for ns in means.values() for n in ns}
    if not words:
        return F.lit("")
    known = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    address = normalized(F.regexp_replace(F.coalesce(image_url, F.lit("")), "[-_/]", " "))
    found = F.array_union(keywords(F.coalesce(c, F.lit("")), lexicon, **kind), keywords(address, lexicon, **kind))
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda n: F.split(F.try_element_at(known, n), " "))))), " ")


def query_parts(c: Column) -> Column:
    """A struct of the query without its organic word, and whether there was one."""
    text = F.substring(F.lower(F.trim(c)), 1, 100)
    return F.struct(
        F.trim(F.regexp_replace(F.regexp_replace(text, r"(?:^|\s)(?:øko|økologisk[a-zæøå]*|organic)(?=$|\s)", " "), r"\s+", " ")).alias("text"),
        text.rlike(VARIANTS["organic"]).alias("organic"),
    )
