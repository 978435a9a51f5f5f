"""Pay and rates as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import let


@dataclass(frozen=True)
class PayPolicy:
    hours_per_year: float = 2080.0
    hours_per_month: float = 173.0
    rates: dict = field(default_factory=lambda: {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "INR": 0.012, "CAD": 0.73, "AUD": 0.66})
    pieces_per_hour: dict = field(default_factory=lambda: {"task": 6.0, "word": 500.0})
    floor: float = 4.5
    year_from: float = 2000.0
    hour_to: float = 200.0


def currency(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("₹|inr|(^|[^a-z])rs[. ]"), "INR").when(low.rlike("€|eur"), "EUR").when(low.rlike("£|gbp"), "GBP")
        .when(low.rlike("cad|c[$]"), "CAD").when(low.rlike("aud|a[$]"), "AUD").otherwise("USD")
    )


def basis(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("(per|/|an) ?(hour|hr|h)([^a-z]|$)|hourly"), "hour").when(low.rlike("(per|/|a) ?(month|mo)([^a-z]|$)|monthly"), "month")
        .when(low.rlike("(per|/|a) ?(year|yr|annum)([^a-z]|$)|annual|yearly"), "year").when(low.rlike("(per|/) ?word"), "word").when(low.rlike("(per|/) ?task"), "task").otherwise("unknown")
    )


def amounts(text: Column) -> Column:
    """All positive amounts; a k makes thousands."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit("([0-9]+(?:[.][0-9]+)?[kK]?)"), F.lit(1))
    value = lambda s: F.regexp_extract(s, "^([0-9.]+)", 1).cast("double") * F.when(F.lower(s).endswith("k"), 1000.0).otherwise(1.0)
    return F.filter(F.transform(found, value), lambda v: v > 0)


def parsed_pay(text: Column, policy: PayPolicy = PayPolicy()) -> Column:
    """basis, hourly low and high in USD, and whether it is an estimate; unknown pay is null, never zero."""
    rate = F.create_map(*[x for k, v in policy.rates.items() for x in (F.lit(k), F.lit(v))])
    stated = F.struct(amounts(text).alias("found"), basis(text).alias("stated"), rate[currency(text)].alias("rate"))
    unknown = F.struct(F.lit("unknown").alias("basis"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("estimate"))

    def per_hour(p: Column) -> Column:
        low, high = F.array_min(p["found"]) * p["rate"], F.array_max(p["found"]) * p["rate"]
        guessed = F.when(p["stated"] != "unknown", p["stated"]).when(high >= policy.year_from, "year").when(high <= policy.hour_to, "hour").otherwise("unknown")
        kind = F.when(F.size(p["found"]) > 0, guessed).otherwise(p["stated"])
        factor = F.when(kind == "hour", 1.0).when(kind == "year", 1 / policy.hours_per_year).when(kind == "month", 1 / policy.hours_per_month)
        for piece, n in policy.pieces_per_hour.items():
            factor = factor.when(kind == piece, n)
        estimate = kind.isin(*policy.pieces_per_hour) & (F.size(p["found"]) > 0)
        return F.struct(kind.alias("basis"), F.round(low * factor, 2).alias("low"), F.round(high * factor, 2).alias("high"), estimate.alias("estimate"))

    return F.when(F.coalesce(F.trim(text) != "", F.lit(False)), let(stated, per_hour)).otherwise(unknown)


def unrounded_rate(nominal: Column, availability: Column, overhead: Column) -> Column:
    """What is left of a rate after idle and unpaid time, between 0 and the rate; for those who round it once, in their own unit."""
    return F.least(F.greatest(F.lit(0.0), nominal * availability * (1 - overhead)), F.greatest(F.lit(0.0), nominal))


def effective_rate(nominal: Column, availability: Column, overhead: Column) -> Column:
    """unrounded_rate() to two places."""
    return F.round(unrounded_rate(nominal, availability, overhead), 2)


def conservative_rate(low: Column, high: Column, availability: Column, overhead: Column) -> Column:
    """The effective rate of the lowest stated pay, as nothing proves more; an unknown overhead takes nothing off, a low of 0 is no statement."""
    nominal = F.coalesce(F.nullif(low, F.lit(0.0)), F.nullif(high, F.lit(0.0)))
    return effective_rate(nominal, F.coalesce(availability, F.lit(1.0)), F.coalesce(overhead, F.lit(0.0)))


def pay_ok(effective: Column, floor: float) -> Column:
    """Null where pay is unknown: that never rejects."""
    return F.when(effective.isNotNull(), effective >= floor)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.least(attempts, F.lit(7)))).cast("long")


def blended(rules: Column, model: Column) -> Column:
    """A model may raise a score half-way, never lower it."""
    return F.greatest(rules, (rules + F.coalesce(model, rules)) / 2)


def review_delta(rating: Column, scale: Column) -> Column:
    return F.greatest(F.lit(-0.03), F.least(F.lit(0.03), (rating / scale - 0.5) * 0.5))


def decay_delta(trust: Column, prior: Column, idle_days: Column, rate: float = 0.01, least_days: int = 30) -> Column:
    """Movement towards the prior after a month of silence, at most rate a month; 0 where there is nothing to move."""
    gap, drift = prior - trust, rate * idle_days / 30
    return F.when((idle_days < least_days) | (F.abs(gap) < 1e-4), 0.0).otherwise(F.greatest(-drift, F.least(drift, gap)))


def range_text(low: Column, high: Column) -> Column:
    return F.when(high.isNull() & low.isNull(), "unknown").when(low.isNull() | (low == high), F.format_string("$%.2f/h", F.coalesce(high, low))).when(high.isNull(), F.format_string("$%.2f/h", low)).otherwise(F.format_string("$%.2f-%.2f/h", low, high))


CURRENCIES = "[$€£₹]|usd|eur|gbp|inr|cad|aud"
AMOUNT = "[0-9][0-9.,]*[kK]?"


def title_pay(title: Column) -> Column:
    """The words of a title that state a currency, an amount or a range, and an hour; null without all of them."""
    low = F.lower(F.translate(title, "\u2013\u2014", "--"))
    said = F.regexp_extract(low, f"((up to )?({CURRENCIES}) ?{AMOUNT}( ?(-|to) ?({CURRENCIES})? ?{AMOUNT})? ?(/|per |an )? ?(hour|hr)\\b)", 1)
    return F.when(said != "", F.trim(said))


def pay_with_source(stated: Column, title: Column, source: Column, policy: PayPolicy = PayPolicy()) -> Column:
    """(basis, low, high, estimate, raw, source): a provider's own pay first, else what the title states by the hour; source tells which, or unknown."""
    own, named = parsed_pay(F.coalesce(stated, F.lit("")), policy), parsed_pay(F.coalesce(title_pay(title), F.lit("")), policy)
    line = lambda p, raw, kind: F.struct(p["basis"].alias("basis"), p["low"].alias("low"), p["high"].alias("high"), p["estimate"].alias("estimate"), raw.alias("raw"), kind.alias("source"))
    by_title = named["high"].isNotNull() & (named["basis"] == "hour")
    return F.when(own["high"].isNotNull(), line(own, stated, F.when(source.startswith("email:"), "email").otherwise("structured"))).when(by_title, line(named, title_pay(title), F.lit("title"))).otherwise(line(own, stated, F.lit("unknown")))


#: What a word after a number makes of it.
SCALES = {"k": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "crore": 1e7, "crores": 1e7}


def claimed_amounts(text: Column) -> Column:
    """Amounts of a claim, with a number's grouping and scale: '1 200,50', '12,00,000', '1.5m', '2 lakh'.

    A last separator with one or two digits after it is the decimal mark, every other one groups.
    """
    scale = "|".join(sorted(SCALES, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(F.translate(text, "\u00a0\u202f", "  ")), F.lit(f"((?:[0-9]{{1,3}}(?:[ .,'][0-9]{{2,3}})+(?:[.,][0-9]{{1,2}})?|[0-9]+(?:[.,][0-9]{{1,2}})?)(?: ?(?:{scale})\\b)?)"), F.lit(1))
    factor = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))])

    def one(a: Column) -> Column:
        number, unit = F.regexp_extract(a, "^([0-9 .,']*[0-9])", 1), F.regexp_extract(a, "([a-z]+)$", 1)
        decimals = F.regexp_extract(number, "[.,]([0-9]{1,2})$", 1)
        whole = F.regexp_replace(F.when(decimals != "", F.regexp_replace(number, "[.,][0-9]{1,2}$", "")).otherwise(number), "[^0-9]", "")
        return F.concat(whole, F.lit("."), F.when(decimals != "", decimals).otherwise("0")).try_cast("double") * F.coalesce(F.try_element_at(factor, unit), F.lit(1.0))

    return F.filter(F.transform(found, one), lambda v: v > 0)


def claim(text: Column, policy: PayPolicy = PayPolicy()) -> Column:
    """(basis, currency, low, high, hourly_low, hourly_high, warnings) of one claim of pay; amounts as stated, hourly ones in USD where the basis allows it."""
    rate = F.create_map(*[x for k, v in policy.rates.items() for x in (F.lit(k), F.lit(v))])
    stated = F.struct(claimed_amounts(text).alias("found"), basis(text).alias("basis"), F.when(F.lower(text).rlike(CURRENCIES + "|(^|[^a-z])rs[. ]"), currency(text)).alias("currency"), F.lower(text).alias("low"))

    def judged(p: Column) -> Column:
        low, high = F.array_min(p["found"]), F.array_max(p["found"])
        per = F.when(p["basis"] == "hour", 1.0).when(p["basis"] == "month", 1 / policy.hours_per_month).when(p["basis"] == "year", 1 / policy.hours_per_year)
        usd = lambda x: F.round(x * rate[p["currency"]] * per, 2)
        warn = {"no_amount": F.size(p["found"]) == 0, "no_currency": p["currency"].isNull() & (F.size(p["found"]) > 0), "no_basis": (p["basis"] == "unknown") & (F.size(p["found"]) > 0), "upper_bound_only": p["low"].rlike("\\bup to\\b"), "several_amounts": F.size(p["found"]) > 2}
        names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in warn.items()]))
        return F.struct(p["basis"].alias("basis"), p["currency"].alias("currency"), low.alias("low"), high.alias("high"), usd(low).alias("hourly_low"), usd(high).alias("hourly_high"), names.alias("warnings"))

    return let(stated, judged)


#: Words of this library's own choice that tell whose money a clause is about.
CONTEXTS = {
    "business": ["revenue", "funding", "valuation", "investors", "turnover", "raised"],
    "pool": ["paid", "contributors", "payouts", "community"],
    "benefit": ["insurance", "stipend", "allowance", "reimbursement", "bonus", "equity"],
}


def money_scope(clause: Column) -> Column:
    """Whose money a clause speaks of: business, benefit, pool (what a platform has paid out to all), or work."""
    words = F.regexp_extract_all(F.lower(clause), F.lit("([a-z]+)"), F.lit(1))
    has = lambda k: F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONTEXTS[k]]))
    every = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in CONTEXTS["pool"]]))) >= 2
    return F.when(clause.isNull(), None).when(has("business"), "business").when(every, "pool").when(has("benefit"), "benefit").otherwise("work")
