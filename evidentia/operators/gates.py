"""Gates: each adds reasons and scores, none drops a row. Filter late, on the verdict."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text, urls

#: Function words by language, most common first; languages are tried in this order and a tie goes to the first.
FUNCTION_WORDS = {
    "de": ["der", "die", "und", "ist", "das", "mit", "von", "zu", "den", "ein", "eine", "nicht", "auch"],
    "es": ["de", "la", "que", "el", "los", "las", "una", "por", "con", "para", "del", "se"],
    "fr": ["le", "les", "des", "est", "et", "une", "dans", "pour", "que", "qui", "sur", "pas"],
}
ENGLISH = ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "by", "this"]
VERDICTS = ("surfaced", "rejected_scam", "rejected_quality", "rejected_location", "rejected_irrelevant", "rejected_pay", "rejected_ineligible", "rejected_trust")


def detected_language(value: Column, words: dict[str, list[str]] = FUNCTION_WORDS, english: list[str] = ENGLISH, first: int = 400) -> Column:
    """The foreign language with the most function words among the first tokens; null without three, or too few beside English."""
    seen = text.first_words(F.coalesce(value, F.lit("")), first)

    def counted(tokens: Column) -> Column:
        count = lambda known: F.size(F.filter(tokens, lambda t: t.isin(*known)))
        hits = F.array(*[F.struct(count(w).alias("n"), F.lit(-i).alias("turn"), F.lit(k).alias("language")) for i, (k, w) in enumerate(words.items())])
        return F.struct(F.array_max(hits).alias("best"), count(english).alias("en"))

    def judged(c: Column) -> Column:
        n, en = c["best"]["n"], c["en"]
        return F.when((n >= 3) & (n >= 1.5 * F.greatest(en, F.lit(1)) / 3) & (n > en / 3), c["best"]["language"])

    return scoring.let(scoring.let(seen, counted), judged)


def language_reasons(value: Column, spoken: Iterable[str]) -> Column:
    foreign = lambda x: F.when(x.isNotNull() & ~x.isin(*spoken), F.array(F.concat(F.lit("posting_language:"), x))).otherwise(F.array().cast("array<string>"))
    return scoring.let(detected_language(value), foreign)


def scam_score(title: Column, body: Column, company: Column, url: Column, phrases: dict[str, tuple[float, str]], free_hosts: list[str], threshold: float = 0.6, least_chars: int = 80) -> tuple[Column, Column]:
    """Additive score and its flags; a listing on a free host reaches the threshold whatever else holds."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    signals = {n: (w, whole.rlike(p)) for n, (w, p) in phrases.items()}
    signals |= {
        "no_company": (0.15, F.coalesce(company, F.lit("")) == ""),
        "thin_description": (0.2, F.length(F.trim(F.coalesce(body, F.lit("")))) < least_chars),
        "shouted_title": (0.15, text.looks_shouted(F.coalesce(title, F.lit("")))),
    }
    free = F.lit(False)
    for h in free_hosts:
        free = free | (urls.host(url) == h) | urls.host(url).endswith("." + h)
    return scoring.weighted(signals, {"free_host": free}, threshold)


def contains_token(tokens: Column, keyword: str) -> Column:
    return F.array_contains(tokens, keyword)


def fit_score(tokens: Column, vocabulary: dict[str, list[str]], anchors: list[str], cap: float = 30.0, base: float = 10.0, phrases: bool = False) -> tuple[Column, Column]:
    """Fit from 0 to 100 and whether a hard exclusion hit. With phrases, keywords may have several words and are found as phrases_in() finds them.

    vocabulary: high (+25), mid (+12), soft (-15) and hard keywords. A fit that
    rests on high keywords alone, without an anchor, is capped.
    """
    if phrases:
        tokens = phrases_in(tokens, sorted({*(k for ks in vocabulary.values() for k in ks), *anchors}))
    hits = lambda kind: sum((F.when(contains_token(tokens, k), 1).otherwise(0) for k in vocabulary.get(kind, [])), F.lit(0))
    high, mid = hits("high"), hits("mid")
    fit = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(base) + 25.0 * high + 12.0 * mid - 15.0 * hits("soft")))
    anchored = F.lit(False)
    for a in anchors:
        anchored = anchored | contains_token(tokens, a)
    capped = F.when((high > 0) & (mid == 0) & ~anchored & F.lit(bool(anchors)), F.least(fit, F.lit(cap))).otherwise(fit)
    hard = hits("hard") > 0
    return F.when(hard, 0.0).otherwise(capped), hard


def title_adjusted(fit: Column, title: Column, penalties: dict[str, tuple[str, float, float | None]]) -> Column:
    """Penalties of all rules whose pattern the title matches are added, and the strictest cap comes last."""
    folded = F.lower(text.fold_dashes(title))
    total = sum((F.when(folded.rlike(p), d).otherwise(0.0) for p, d, _ in penalties.values()), F.lit(0.0))
    caps = [F.when(folded.rlike(p), c) for p, _, c in penalties.values() if c is not None]
    out = F.greatest(F.lit(0.0), fit + total)
    return F.least(out, *caps, F.lit(100.0)) if caps else out


def location_reasons(location: Column, body: Column, remote: Column, home: list[str]) -> Column:
    """Rules in order: said to be on site, a place that is not home, or nothing that says remote."""
    place, low = F.lower(F.coalesce(location, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    at_home = F.lit(False)
    for h in home:
        at_home = at_home | place.contains(h)
    reason = F.when(low.rlike("\\b(on-site|onsite|in office) (only|required)\\b"), "onsite").when(at_home | F.coalesce(remote, F.lit(False)) | place.contains("remote") | place.contains("worldwide"), None).when(place != "", "place").otherwise("not_remote")
    return F.when(reason.isNotNull(), F.array(F.concat(F.lit("location:"), reason))).otherwise(F.array().cast("array<string>"))


def verdict(scam: Column, quality: Column, location: Column, hard: Column, pay_ok: Column, ineligible: Column, trust: Column, fit: Column, least_trust: float = 0.25, least_fit: float = 32.0) -> Column:
    """The first gate that rejects, in order of severity. Unknown pay and trust reject nothing."""
    early = {"rejected_scam": scam, "rejected_quality": F.size(quality) > 0, "rejected_location": F.size(location) > 0, "rejected_irrelevant": hard}
    late = {"rejected_pay": ~pay_ok, "rejected_ineligible": F.size(ineligible) > 0, "rejected_trust": trust < least_trust}
    rest = F.when(fit < least_fit, "rejected_irrelevant").otherwise("surfaced")
    return F.coalesce(F.nullif(scoring.first_reason(early, ""), F.lit("")), F.nullif(scoring.first_reason(late, ""), F.lit("")), rest)


def decided(df: DataFrame, blockers: str, precedence: list[str]) -> DataFrame:
    """df with terminal: of the array of blockers that which comes first in the precedence, or null."""
    order = F.array(*[F.lit(p) for p in precedence])
    return df.withColumn("terminal", F.get(F.filter(order, lambda p: F.array_contains(F.col(blockers), p)), 0))


def domain_tier(df: DataFrame, url: str, tiers: DataFrame) -> DataFrame:
    """df with tier and prior of the URL's registrable domain; tiers (domain, tier, prior), 'unknown' and null beyond them."""
    keyed = df.withColumn("_domain", urls.registrable(F.col(url)))
    return keyed.join(tiers.select(F.col("domain").alias("_domain"), "tier", "prior"), "_domain", "left").drop("_domain").withColumn("tier", F.coalesce("tier", F.lit("unknown")))


def language_pairs(required: Column, spoken: Column, all_of: Column) -> Column:
    """Whether required languages are covered: each of a pair, or any of a list; none required is fine."""
    return F.when(F.size(required) == 0, True).when(all_of, F.size(F.array_except(required, spoken)) == 0).otherwise(F.arrays_overlap(required, spoken))


def common_letters(a: str, b: str) -> int:
    """The length of the longest common subsequence, one bit a letter of a and one step a letter of b."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def same_token(want: str, have: str, least: float = 88, short: int = 4) -> bool:
    """Short tokens must be equal; longer ones may differ by an ending of `short` letters, or be alike to `least` percent."""
    a, b = sorted((want, have), key=len)
    if a == b or len(a) <= short:
        return a == b
    stem = b.startswith(a) and len(b) - len(a) <= short
    return stem or 200 * common_letters(a, b) >= least * (len(a) + len(b))


def phrase_found(want: list[str], have: list[str], slack: int = 2) -> bool:
    """All tokens of the phrase in order, the last at most `slack` tokens farther than if they stood side by side."""
    alike = {t: [same_token(w, t) for w in want] for t in set(have)}
    return placed([[j for j, t in enumerate(have) if alike[t][i]] for i in range(len(want))], slack)


def placed(places: list[list[int]], slack: int) -> bool:
    """Whether one place of each list, in ascending order, fits a window of the lists' number and the slack."""
    reach = len(places) + slack
    ends = {p: p for p in places[0]} if places else {}  # first place -> earliest place of the latest token
    for following in places[1:]:
        step = {first: bisect.bisect_right(following, at) for first, at in ends.items()}
        ends = {first: following[k] for first, k in step.items() if k < len(following) and following[k] < first + reach}
    return bool(ends)


def phrases_in(tokens: Column, phrases: list[str], slack: int = 2) -> Column:
    """The phrases that an array of tokens holds. Similar tokens count, so this is an Arrow function.

    Each distinct token of a batch is compared once with each word of the phrases.
    """
    wanted = [(p, p.lower().split()) for p in phrases]
    vocabulary = sorted({w for _, ws in wanted for w in ws})

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batch: pd.Series) -> pd.Series:
        like: dict[str, list[str]] = {}

        def found(row: list[str] | None) -> list[str]:
            at: dict[str, list[int]] = {w: [] for w in vocabulary}
            for j, token in enumerate(() if row is None else row):
                if token not in like:
                    like[token] = [] if token is None else [w for w in vocabulary if same_token(w, token)]
                for w in like[token]:
                    at[w].append(j)
            return [p for p, ws in wanted if ws and all(at[w] for w in ws) and placed([at[w] for w in ws], slack)]

        return batch.map(found)

    return run(tokens)
