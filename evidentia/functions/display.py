"""Lines for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Concerns in the order in which warnings are shown, each with words that tell it; callers may bring their own.
CONCERNS = {"where": ["location", "visa", "country"], "money": ["pay", "rate", "fee"], "safety": ["trust", "fraud", "scam"], "time": ["old", "stale", "expired"]}


def run_summary(counts: dict[str, Column]) -> Column:
    """'name n' for each count, zeros included, so that nothing seems to be missing."""
    return F.concat_ws(" | ", *[F.concat_ws(" ", F.lit(n), c.cast("string")) for n, c in counts.items()])


def card(title: Column, company: Column, pay: Column, place: Column, url: Column, reasons: Column) -> Column:
    """The lines of one listing; empty ones are left out."""
    return F.concat_ws("\n", F.concat_ws(" - ", title, company), F.concat_ws(" | ", pay, place), F.when(F.size(reasons) > 0, F.concat(F.lit("Check: "), F.array_join(reasons, "; "))), url)


def ordered_warnings(values: Column, concerns: dict[str, list[str]] = CONCERNS) -> Column:
    """Distinct warnings by concern, in the order of the table, then by name; those of no concern come last."""
    place = {w: i for i, words in enumerate(concerns.values()) for w in words}
    known = F.create_map(*[x for w, i in place.items() for x in (F.lit(w), F.lit(i))])
    words = lambda v: F.regexp_extract_all(F.lower(v), F.lit("([a-z]+)"), F.lit(1))
    rank = lambda v: F.coalesce(F.array_min(F.transform(words(v), lambda w: F.try_element_at(known, w))), F.lit(len(concerns)))
    keyed = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(rank(v).alias("r"), F.lower(v).alias("l"), v.alias("v"))))
    return F.transform(keyed, lambda k: k["v"])


def compacted(lines: Column, most: int = 5) -> Column:
    """Distinct lines, at most so many, and how many more there are."""
    unique = F.array_distinct(lines)
    more = F.when(F.size(unique) > most, F.array(F.format_string("+%d more", F.size(unique) - most))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(unique, 1, most), more)


def subject(cards: Column, statuses: Column, day: Column) -> Column:
    plural = lambda n, w: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n > 1, "s").otherwise("")))
    return F.concat_ws(" ", F.coalesce(F.nullif(F.concat_ws(", ", plural(cards, "listing"), plural(statuses, "update")), F.lit("")), F.lit("no changes")), F.date_format(day, "(yyyy-MM-dd)"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise("-")
