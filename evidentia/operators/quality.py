"""Whether a page is a single listing at all, and whether a person may take it: reasons, never dropped rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scoring, text, urls

#: Words of this library's own choice by which a title names one position.
POSITIONS = ["analyst", "annotator", "consultant", "designer", "developer", "editor", "engineer", "manager", "nurse", "rater", "reviewer", "teacher", "tester", "translator", "tutor", "writer"]
PLENTY = ["jobs", "openings", "vacancies", "positions", "roles"]
ARTICLES = ["article", "articles", "blog", "guide", "guides", "news", "resources"]
ADVICE = ["how", "guide", "tips", "best", "top", "why"]


def junk_reasons(title: Column, url: Column, company: Column, has_rate: Column, farm: Column, publishers: Iterable[str] = (), short_title: int = 25) -> Column:
    """Reasons why a page is not one listing: a count of jobs, a search, an index, a category, nobody behind it, a publisher, an article, a farm copy."""
    words = text.tokens(F.coalesce(title, F.lit("")))
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    steps = F.filter(F.split(F.lower(urls.path(F.coalesce(url, F.lit("")))), "/"), lambda s: s != "")
    names = F.transform(F.split(urls.query(F.coalesce(url, F.lit(""))), "&"), lambda p: F.lower(F.regexp_extract(p, "^([^=]*)=", 1)))
    last = F.element_at(F.concat(F.array(F.lit("")), steps), -1)
    counted = F.get(words, F.lit(0)).rlike("^[0-9]+$") & has(PLENTY)
    listed = F.array(*[F.lit(a) for a in ARTICLES])
    return scoring.flags(
        {
            "junk:count_title": counted,
            "junk:search_page": F.arrays_overlap(names, F.array(F.lit("q"), F.lit("query"), F.lit("search"))) | F.array_contains(steps, "search"),
            "junk:index_page": last.isin(*PLENTY, "categories", "companies"),
            "junk:category_title": ~counted & has(PLENTY) & ~has(POSITIONS),
            "junk:nobody": (F.coalesce(F.trim(company), F.lit("")) == "") & ~F.coalesce(has_rate, F.lit(False)) & (F.length(F.coalesce(title, F.lit(""))) < short_title),
            "junk:publisher": F.lower(F.trim(company)).isin(*publishers) if list(publishers) else F.lit(False),
            "junk:article": F.arrays_overlap(steps, listed) | F.get(words, F.lit(0)).isin(*ADVICE),
            "junk:farm_copy": F.coalesce(farm, F.lit(False)),
        }
    )


def on_host(url: Column, hosts: Iterable[str]) -> Column:
    """Whether the URL's host is one of the hosts or below one."""
    found = F.lit(False)
    for h in hosts:
        found = found | (urls.host(url) == h) | urls.host(url).endswith("." + h)
    return F.coalesce(found, F.lit(False))


def scam_bumps(title: Column, url: Column, free_hosts: Iterable[str], invented: Iterable[str]) -> Column:
    """scam:free_host and scam:absurd_language:x, for a page anybody can put up and for a language nobody pays for."""
    words = F.array(*[F.lit(w) for w in sorted(invented)])
    spoken = F.array_sort(F.array_intersect(text.word_tokens(F.coalesce(title, F.lit(""))), words))
    free = F.when(on_host(url, free_hosts), F.array(F.lit("scam:free_host"))).otherwise(F.array().cast("array<string>"))
    return F.concat(free, F.transform(spoken, lambda w: F.concat(F.lit("scam:absurd_language:"), w)))


def title_languages(title: Column, known: Iterable[str], aliases: dict[str, str]) -> Column:
    """(pair, names): the languages that a title names, and whether two stand side by side as a pair ("a to b", "a/b", "a-b", "a into b"), which then are all that count."""
    named = F.array(*[F.lit(k) for k in sorted({*known, *aliases})])
    names = F.create_map(*[x for k in sorted({*known, *aliases}) for x in (F.lit(k), F.lit(aliases.get(k, k)))])
    words = F.regexp_extract_all(F.lower(text.fold_dashes(F.coalesce(title, F.lit("")))), F.lit("([\\p{L}]+|[/>-])"), F.lit(1))
    spot = lambda w: F.array_contains(named, w)

    def judged(ws: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(ws))
        second = lambda i: F.get(ws, i + 1)  # noqa: E731  i counts from one, get() from zero: the word after the next
        paired = F.filter(at, lambda i: spot(F.get(ws, i - 1)) & F.get(ws, i).isin("to", "into", "/", "-", ">") & F.coalesce(spot(second(i)), F.lit(False)))
        pairs = F.flatten(F.transform(paired, lambda i: F.array(F.get(ws, i - 1), second(i))))
        single = F.filter(ws, spot)
        found = F.when(F.size(paired) > 0, pairs).otherwise(single)
        return F.struct((F.size(paired) > 0).alias("pair"), F.array_sort(F.array_distinct(F.transform(found, lambda w: F.try_element_at(names, w)))).alias("names"))

    nothing = F.struct(F.lit(False).alias("pair"), F.array().cast("array<string>").alias("names"))
    return scoring.let(words, lambda ws: F.when(F.size(ws) > 0, judged(ws)).otherwise(nothing))


def language_gate(title: Column, known: Iterable[str], aliases: dict[str, str], spoken: Iterable[str]) -> Column:
    """lang_mismatch:x of a title: every missing language of a pair; of others all, unless one is spoken."""
    own = F.array(*[F.lit(s) for s in sorted({aliases.get(s, s) for s in spoken})])

    def reasons(t: Column) -> Column:
        missing = F.array_except(t["names"], own)
        return F.transform(F.when(~t["pair"] & F.arrays_overlap(t["names"], own), F.array().cast("array<string>")).otherwise(missing), lambda m: F.concat(F.lit("lang_mismatch:"), m))

    return scoring.let(title_languages(title, known, aliases), reasons)


def credential_gate(title: Column, gated: dict[str, str], held: dict[str, list[str]]) -> Column:
    """credential_mismatch:role:text for each gated role whose pattern the title matches in words that name no held domain.

    held names domains with their other names; holding a domain covers all of them.
    """
    low = F.lower(text.fold_dashes(F.coalesce(title, F.lit(""))))
    domains = F.array(*[F.lit(w) for k, ws in sorted(held.items()) for w in sorted({k, *ws})]) if held else F.array().cast("array<string>")

    def one(role: str, pattern: str) -> Column:
        said = F.regexp_extract(low, f"({pattern})", 1)
        covered = F.exists(domains, lambda d: F.contains(F.concat(F.lit(" "), text.identity_text(said), F.lit(" ")), F.concat(F.lit(" "), d, F.lit(" "))))
        return F.when((said != "") & ~covered, F.concat(F.lit(f"credential_mismatch:{role}:"), F.trim(said)))

    return F.array_compact(F.array(*[one(r, p) for r, p in gated.items()]))


def eligibility(title: Column, known: Iterable[str], aliases: dict[str, str], spoken: Iterable[str], gated: dict[str, str], held: dict[str, list[str]]) -> Column:
    """(passed, reasons) of the language gate and then the credential gate."""
    reasons = F.concat(language_gate(title, known, aliases, spoken), credential_gate(title, gated, held))
    return scoring.let(reasons, lambda r: F.struct((F.size(r) == 0).alias("passed"), r.alias("reasons")))


def needs_hydration(kind: Column, description: Column, complete: Column, cycles: Column, next_check: Column, as_of: Column, most_cycles: int = 2, enough: int = 1000) -> Column:
    """Whether a look at the original page may add something: an original or unresolved source whose text is short or incomplete, and no pause after failed looks."""
    worth = kind.isin("original_employer", "original_ats", "aggregator_unresolved")
    thin = (kind == "aggregator_unresolved") | ~F.coalesce(complete, F.lit(False)) | (F.length(F.trim(F.coalesce(description, F.lit("")))) < enough)
    pausing = F.coalesce((cycles >= most_cycles) & (next_check > as_of), F.lit(False))
    return F.coalesce(worth & thin, F.lit(False)) & ~pausing
