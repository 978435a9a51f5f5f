"""Text as columns. Patterns stay in the subset that Java and RE2 read alike."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2043"
HIDDEN = "[\u200b\u2060\ufeff]"  # joiners U+200C and U+200D carry meaning and stay
BLANKS = "[\u00a0\u2000-\u200a\u202f\u205f\u3000\t]"
#: Cyrillic letters that look like Latin ones.
LOOKALIKES = ("АВЕКМНОРСТХаеорсухі", "ABEKMHOPCTXaeopcyxi")
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


def display_text(value: Column) -> Column:
    """Text for people: line ends, hidden and control characters, blanks and empty lines put in order; applying it twice changes nothing."""
    c = F.regexp_replace(value, "\r\n?", "\n")
    c = F.regexp_replace(c, HIDDEN, "")
    c = F.regexp_replace(c, BLANKS, " ")
    c = F.regexp_replace(c, "[\\x00-\\x09\\x0b-\\x1f\\x7f]", "")
    c = F.regexp_replace(c, " *\n *", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " "), F.lit(" \n"))


def fold_dashes(value: Column) -> Column:
    return F.translate(value, DASHES, "-" * len(DASHES))


def match_text(value: Column) -> Column:
    return F.lower(fold_dashes(display_text(value)))


def fold_lookalikes(value: Column) -> Column:
    return F.translate(value, *LOOKALIKES)


def unescaped(value: Column) -> Column:
    """Character references of HTML, named and numbered, as their characters; what is no reference stays. Text between ampersands is looked at once, so nothing is decoded twice."""
    names = F.create_map(*[x for n, c in sorted(name2codepoint.items()) for x in (F.lit(n), F.lit(chr(c)))])
    number = lambda p, pattern, base: F.conv(F.regexp_extract(p, pattern, 1), base, 10).cast("long")
    char = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(p: Column) -> Column:
        decimal, hexadecimal, name = "^#([0-9]{1,7});", "^#[xX]([0-9a-fA-F]{1,6});", "^([A-Za-z][A-Za-z0-9]*);"
        plain = F.when(p.rlike(decimal), char(number(p, decimal, 10))).when(p.rlike(hexadecimal), char(number(p, hexadecimal, 16))).when(p.rlike(name), F.try_element_at(names, F.regexp_extract(p, name, 1)))
        return F.coalesce(F.concat(plain, F.regexp_replace(p, "^[^;]*;", "")), F.concat(F.lit("&"), p))

    parts = F.split(value, "&")
    found = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(F.contains(value, F.lit("&")), found).otherwise(value)


def html_text(value: Column) -> Column:
    """Visible text of markup: references decoded first, so that escaped markup is markup; no scripts, styles or comments; list items get a mark, blocks a line."""
    c = F.regexp_replace(unescaped(value), "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, "(?i)<li[^>]*>", "\n- ")
    c = F.regexp_replace(c, "(?i)<(br|/p|/div|/h[1-6]|/tr|/ul|/ol)[^>]*>", "\n")
    return display_text(F.regexp_replace(c, "<[^>]*>", " "))


#: Elements of a page that are not part of the role it describes.
CONTROLS = ("form", "nav", "header", "footer", "aside", "button", "select", "script", "style", "template")


def role_markup(value: Column, limited: bool = True) -> Column:
    """Markup without forms, navigation and controls, however they nest; null where one of them is not closed for sure, as then nothing after it is sure to belong to the role, and, if limited, where a page has more tags or depth than elements allows."""
    from . import elements

    return elements.without(elements.decoded(value), elements.is_control(CONTROLS), limited=limited)


def identity_text(value: Column) -> Column:
    """Text for comparing names: lower case, letters, digits, marks, + and # alone."""
    return F.trim(F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}\\p{M}+#]+", " "))


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9+#]+)"), F.lit(1))


def word_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit("(\\p{L}+)"), F.lit(1))


def first_words(value: Column, n: int) -> Column:
    """The first n of word_tokens(); what follows them is not cut up."""
    cut = F.split(F.lower(value), "\\P{L}+", n + 2)  # an empty first one where the text begins otherwise, n words, the rest
    return F.slice(F.filter(F.slice(cut, 1, n + 1), lambda w: w != ""), 1, n)


def segments(value: Column) -> Column:
    """Sentences and list entries, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value, "[\\n;•]|[.!?] "), lambda s: F.trim(s)), lambda s: s != "")


def number_of(value: Column) -> Column:
    """A number written in digits or as a word up to twelve."""
    words = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(n)))])
    return F.coalesce(F.try_element_at(words, F.lower(value)), value.try_cast("double"))


def display_slug(value: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(value, "[-_+]+", " ")))


def modality(clause: Column, required: bool = False) -> Column:
    """Whether a clause demands, prefers, leaves open or denies what it names."""
    low = F.lower(clause)
    return (
        F.when(low.rlike("\\b(no|not|without)\\b[^.]{0,40}\\b(required|needed|necessary)\\b"), "negated")
        .when(low.rlike("\\b(optional|if you have|not mandatory)\\b"), "optional")
        .when(low.rlike("\\b(preferred|a plus|nice to have|ideally|advantage)\\b"), "preferred")
        .when(low.rlike("\\b(must|required|need|needed|mandatory|essential)\\b"), "required")
        .otherwise("required" if required else "mentioned")
    )


def looks_shouted(title: Column) -> Column:
    """At least ten letters, four in five of them capitals."""
    letters = F.length(F.regexp_replace(title, "[^\\p{L}]", ""))
    return F.coalesce((letters >= 10) & (F.length(F.regexp_replace(title, "[^\\p{Lu}]", "")) >= 0.8 * letters), F.lit(False))


@F.pandas_udf(T.StringType())
def composed(value: pd.Series) -> pd.Series:
    """Unicode NFC, for which Spark has no function."""
    return value.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def compatible(value: pd.Series) -> pd.Series:
    """Unicode NFKC with case folded."""
    return value.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def repaired(value: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252 put right, where the round trip succeeds."""

    def one(s: str | None) -> str | None:
        if s is None or not any(c in s for c in "Ãâ"):
            return s
        try:
            return s.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return s

    return value.map(one)


def people_text(value: Column) -> Column:
    """display_text() of a text whose encoding is put right and whose letters are composed (NFC)."""
    return display_text(composed(repaired(value)))


def identity_key(value: Column) -> Column:
    """identity_text() after NFKC and case folding, so that wide, ligated and sharp letters compare alike."""
    return identity_text(compatible(value))


def known_name(value: Column, aliases: dict[str, str]) -> Column:
    """The name that a company goes by: what its identity text stands for among the aliases, else the name as it is."""
    names = F.create_map(*[x for k, v in sorted(aliases.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, identity_text(value)), F.trim(value))
