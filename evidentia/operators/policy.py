"""Decisions from evidence: identity, pay, payout, equipment, place, role, life cycle and the order of what is next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text, times

FILLER = ["remote", "job", "role"]


def words(value: Column) -> Column:
    return F.array_except(F.array_distinct(text.tokens(F.coalesce(value, F.lit("")))), F.array(*[F.lit(w) for w in FILLER]))


def named(value: Column, names: list[str]) -> Column:
    """Those of the names that stand in a text as whole words."""
    line = F.concat(F.lit(" "), text.identity_text(F.coalesce(value, F.lit(""))), F.lit(" "))
    return F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f" {n} ")), F.lit(n)) for n in names]))


def same_listing(old: str, new: str, languages: list[str], countries: list[str]) -> Column:
    """conflict, exact, corroborated or uncertain for two structs (id, title, company, location) of one listing, before and after a lookup.

    Known and different companies, titles that share under half of the old words, and
    languages or countries without a common one are conflicts; then equal ids are
    exact, equal titles corroborate.
    """
    a, b = (lambda f: F.col(f"{old}.{f}")), (lambda f: F.col(f"{new}.{f}"))
    firm = lambda x: F.nullif(text.identity_text(x), F.lit(""))
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    wa, wb = words(a("title")), words(b("title"))
    few = (F.size(wa) > 0) & (F.size(wb) > 0) & (F.size(F.array_intersect(wa, wb)) < 0.5 * F.size(wa))
    remote = F.lower(F.concat_ws(" ", a("location"), b("location"))).contains("remote")
    title = lambda x: F.nullif(F.lower(F.trim(x)), F.lit(""))
    conflict = F.coalesce(firm(a("company")) != firm(b("company")), F.lit(False)) | few | apart(named(a("title"), languages), named(b("title"), languages))
    conflict = conflict | (~remote & apart(named(a("location"), countries), named(b("location"), countries)))
    return scoring.first_reason({"conflict": conflict, "exact": F.nullif(a("id"), F.lit("")) == b("id"), "corroborated": title(a("title")) == title(b("title"))}, "uncertain")


def pay_state(selected: str, conflict: Column, below_floor: Column, credibility: Column, least: float = 0.65) -> Column:
    """The first that holds of unknown, conflicted, below_floor, budget_known, up_to_only, known_unverified, credible_salary, credible_hourly."""
    basis = F.col(f"{selected}.basis")
    return (
        F.when(basis.isNull() | (basis == "unknown"), "unknown").when(conflict, "conflicted").when(F.coalesce(below_floor, F.lit(False)), "below_floor").when(basis == "fixed", "budget_known")
        .when(F.coalesce(F.col(f"{selected}.up_to"), F.lit(False)), "up_to_only").when(credibility < least, "known_unverified").when(basis.isin("year", "month"), "credible_salary").otherwise("credible_hourly")
    )


def payout(routes: DataFrame, id_: str) -> DataFrame:
    """Per id whether an amount can be paid out, for routes (id, method, amount, currency, minimum, minimum_currency, strict).

    Amounts are decimals. A route is compatible if its minimum is met in the same
    currency, infeasible if it isn't, unknown otherwise. All terms of a method must be
    compatible for the method to be; one such method is enough; all routes
    infeasible make the id infeasible.
    """
    met = F.when(F.col("strict"), F.col("amount") > F.col("minimum")).otherwise(F.col("amount") >= F.col("minimum"))
    state = F.when(F.col("currency") != F.col("minimum_currency"), "unknown").when(met, "compatible").when(~met, "infeasible").otherwise("unknown")
    state = F.when(F.col("currency").isNull() | F.col("minimum_currency").isNull(), "unknown").otherwise(state)
    each = routes.withColumn("_s", state).groupBy(id_, "method").agg(F.min((F.col("_s") == "compatible").cast("int")).alias("all"), F.min((F.col("_s") == "infeasible").cast("int")).alias("none"))
    return each.groupBy(id_).agg(F.when(F.max("all") == 1, "compatible").when(F.min("none") == 1, "infeasible").otherwise("unknown").alias("payout"))


def inventory(records: DataFrame, device: str, as_of: Column) -> DataFrame:
    """device and state of what is owned: of records (device, event_date, available) the latest dated ones; undated or unknown ones leave it unknown, two answers are a conflict."""
    known = records.where(F.col("event_date").isNull() | (F.col("event_date") <= as_of))
    last = known.groupBy(device).agg(F.max("event_date").alias("_last"))
    kept = known.join(last, device).where(F.col("event_date").isNull() | (F.col("event_date") == F.col("_last")))
    unknown = F.max((F.col("event_date").isNull() | F.col("available").isNull()).cast("int")) == 1
    return kept.groupBy(device).agg(F.when(unknown, "unknown").when(F.count_distinct("available") > 1, "conflict").when(F.max("available"), "available").otherwise("unavailable").alias("state"))


def equipment(claims: DataFrame, owned: DataFrame, device: str) -> DataFrame:
    """claims (device, modality) with outcome against inventory()."""
    out = claims.join(owned, device, "left")
    return out.withColumn("outcome", F.when(F.col("modality") == "negated", "not_required").when(F.col("modality") != "required", "preferred").when(F.col("state") == "available", "supported").when(F.col("state") == "unavailable", "unmet").otherwise(F.coalesce("state", F.lit("unknown"))))


#: Words by which a sentence speaks of whom it takes, of the employer itself, and of exceptions.
RESTRICTING = ["only", "must", "resident", "residents", "citizen", "citizens", "residing", "reside", "exclusively", "restricted"]
EMPLOYER = ["we", "our", "company", "hq", "headquarters", "headquartered", "office", "offices", "founded"]
EXCEPTING = ["not", "never", "except", "excluding", "excluded", "outside", "without", "unless"]


def overlaps(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def region_lock(title: Column, body: Column, countries: list[str], home: list[str], first: int = 600) -> Column:
    """The first country, not home, that a sentence restricts applicants to.

    A sentence restricts where it names the country with a restricting word, or as
    "<country> based"; one that speaks of the employer or of exceptions restricts nothing.
    """
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(first)))
    sentences = F.transform(F.split(whole, "[.;\\n]"), text.tokens)
    plain = F.filter(sentences, lambda t: ~overlaps(t, EMPLOYER) & ~overlaps(t, EXCEPTING))

    def locking(country: str):
        named = country.split()
        line = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        return lambda t: F.contains(line(t), F.lit(f" {' '.join(named)} ")) & (overlaps(t, RESTRICTING) | F.contains(line(t), F.lit(f" {' '.join(named)} based ")))

    hit = F.lit(None).cast("string")
    for c in reversed([c for c in countries if c not in home]):
        hit = F.when(F.exists(plain, locking(c)), c).otherwise(hit)
    return hit


#: A closing statement: how it begins, what it is about, how it ends, and what makes it no statement about now.
NOTICE_BEGINS = ["this", "the", "applications", "sorry", "role", "vacancy", "position"]
NOTICE_SUBJECTS = ["role", "vacancy", "position", "job", "opening", "posting", "project", "listing", "applications"]
NOTICE_ENDS = ["closed", "filled", "expired", "ended", "withdrawn", "unavailable"]
NOTICE_OPEN = ["not", "if", "when", "until", "unless", "once", "before", "soon", "will"]


def scoped_closure(html: Column, title: Column, most_words: int = 12) -> Column:
    """Whether a page with one heading, equal to the title, says in a short block of its own that this role is closed."""
    headings = F.transform(F.regexp_extract_all(html, F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), lambda h: F.lower(text.html_text(h)))
    blocks = F.transform(F.split(text.html_text(html), "\n"), text.tokens)
    says = lambda t: F.size(t).between(3, most_words) & F.get(t, F.lit(0)).isin(*NOTICE_BEGINS) & overlaps(t, NOTICE_SUBJECTS) & overlaps(t, NOTICE_ENDS) & ~overlaps(t, NOTICE_OPEN)
    return F.coalesce((F.size(headings) == 1) & (F.get(headings, F.lit(0)) == F.lower(F.trim(title))) & F.exists(blocks, says), F.lit(False))


def specialist(title: Column, aliases: dict[str, list[str]], claimed: list[str], generalist: Column) -> Column:
    """(domain, status): the domain whose alias stands earliest in the title, the longest of those; claimed, unclaimed or none."""
    line = F.concat(F.lit(" "), text.identity_text(F.coalesce(title, F.lit(""))), F.lit(" "))
    hits = F.filter(F.array(*[F.struct(F.instr(line, F.lit(f" {a} ")).alias("at"), F.lit(-len(a)).alias("n"), F.lit(d).alias("domain")) for d, names in aliases.items() for a in names]), lambda h: h["at"] > 0)
    best = F.array_min(hits)["domain"]
    domain = F.when(~F.coalesce(generalist, F.lit(False)), best)
    return F.struct(domain.alias("domain"), F.when(domain.isNull(), "none").when(domain.isin(*claimed), "claimed").otherwise("unclaimed").alias("status"))


def occupation(title: Column, families: dict[str, str], otherwise: str = "other") -> Column:
    """The first family whose pattern the title matches."""
    low = F.lower(text.fold_dashes(F.coalesce(title, F.lit(""))))
    return scoring.first_reason({k: low.rlike(p) for k, p in families.items()}, otherwise)


def language_mismatches(required: Column, spoken: Column, any_of: Column) -> Column:
    """lang_mismatch:x for each required language that isn't spoken, none if any of a list is enough and one is."""
    missing = F.array_sort(F.array_except(required, spoken))
    return F.when(any_of & F.arrays_overlap(required, spoken), F.array().cast("array<string>")).otherwise(F.transform(missing, lambda m: F.concat(F.lit("lang_mismatch:"), m)))


def location_mismatches(scopes: Column, negative: Column, home: str, accessible: list[str]) -> Column:
    within = F.arrays_overlap(scopes, F.array(*[F.lit(a) for a in accessible]))
    excluded = F.when(F.array_contains(scopes, home), F.array(F.lit(f"location_scope_mismatch:{home}_excluded"))).otherwise(F.array().cast("array<string>"))
    return F.when(negative, excluded).when(within, F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(scopes), lambda s: F.concat(F.lit("location_scope_mismatch:"), s)))


def experience_mismatches(years: Column, most: float) -> Column:
    over = F.sort_array(F.array_distinct(F.filter(years, lambda y: y > most)), asc=False)
    return F.transform(over, lambda y: F.format_string("experience_mismatch:%s_years", F.regexp_replace(y.cast("string"), "\\.0$", "")))


def lifecycle(df: DataFrame, as_of: Column, watch_days: float = 14, copy_days: float = 30, most_cycles: int = 2) -> DataFrame:
    """df with lifecycle, reason and tasks, from captured facts; rules come in order and the first decides.

    Needs closed, deadline, blocked, applied, pool, cycles, first_failed, posted,
    authoritative, complete, verified_open and route. A deadline that has come is
    over. Failed checks alone hide nothing: the posting, or the time that checks have
    failed, must be older than watch_days.
    """
    age = times.days_between(F.col("posted"), as_of)
    failing = times.days_between(F.col("first_failed"), as_of)
    old = F.coalesce(age > watch_days, failing > watch_days, F.lit(False))
    rules = {
        "matching_source_closed": F.col("closed"),
        "deadline_elapsed": F.col("deadline") <= as_of,
        "account_block": F.col("blocked"),
        "already_applied": F.col("applied"),
        "pool_not_work": F.col("pool"),
        "verification_exhausted": (F.col("cycles") >= most_cycles) & old,
        "stale_copy": ~F.col("authoritative") & (age > copy_days),
    }
    reason = scoring.first_reason(rules, "")
    state = F.when(reason.isin("matching_source_closed", "deadline_elapsed"), "closed").when(reason == "", "active").otherwise("watch")
    tasks = scoring.flags({"requirements": ~F.coalesce("complete", F.lit(False)), "open_status": ~times.within(as_of, F.col("verified_open"), 48), "route": ~F.coalesce("route", F.lit(False))})
    return df.withColumns({"lifecycle": state, "reason": F.nullif(reason, F.lit("")), "tasks": tasks})


def action_band(terminal: Column, eligible: Column, lifecycle_: Column, tasks: Column, conflict: Column) -> Column:
    """reject with a terminal reason, primary if nothing is left to verify, else verify."""
    ready = (eligible == "passed") & (lifecycle_ == "active") & (F.size(tasks) == 0) & ~conflict
    return F.when(terminal.isNotNull(), "reject").when(F.coalesce(ready, F.lit(False)), "primary").otherwise("verify")


def priority(parts: dict[str, Column], id_: str) -> list[Column]:
    """A total order: parts from high to low in their order, unknown ones last, then the id."""
    return [*[F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in parts.values()], F.col(id_).asc()]


def urgency(deadline: Column, as_of: Column, minutes: Column, lead_minutes: Column, tasks: Column, window_hours: float = 24) -> Column:
    """elapsed, unknown, infeasible, urgent (within the window and nothing to verify) or feasible."""
    left = times.days_between(as_of, deadline) * 1440
    need = F.greatest(minutes, F.coalesce(lead_minutes, F.lit(0.0)))
    return F.when(deadline.isNull(), None).when(left <= 0, "elapsed").when(minutes.isNull(), "unknown").when(left < need, "infeasible").when((left <= window_hours * 60) & (F.size(tasks) == 0), "urgent").otherwise("feasible")


def requirements_rollup(claims: DataFrame, id_: str) -> DataFrame:
    """Per id the required and preferred names, the range of years, and how complete they are, for claims (id, name, modality, years, completeness)."""
    rank = {"unknown": 0, "partial": 1, "complete": 2}
    grade = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    names = lambda m: F.array_sort(F.collect_set(F.when(F.col("modality") == m, F.col("name"))))
    out = claims.groupBy(id_).agg(names("required").alias("required"), names("preferred").alias("preferred"), F.min("years").alias("least_years"), F.max("years").alias("most_years"), F.max(grade[F.col("completeness")]).alias("_g"))
    return out.withColumn("completeness", F.get(F.array(*[F.lit(k) for k in rank]), F.coalesce("_g", F.lit(0)))).drop("_g")
