"""Observations: raw records with their identity, origin and state of capture; failures are rows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, payloads, scoring, text, urls


def canonical_payload(raw: Column) -> Column:
    """A JSON object with the names at every depth in order, so that the order in which a provider wrote them tells nothing apart; null for anything else."""
    return payloads.canonical_object(raw)


def built(df: DataFrame, source: str, raw: str, url: str, title: str) -> DataFrame:
    """df with observation_id, payload, public_url and normalization_error.

    A record whose JSON can't be read, or that has no title, keeps its row and names what is wrong.
    """
    payload = canonical_payload(F.col(raw))
    out = df.withColumn("payload", payload).withColumn("public_url", urls.sanitized(F.col(url)))
    error = F.when(F.col("payload").isNull(), "malformed_payload").when(F.coalesce(F.trim(F.col(title)), F.lit("")) == "", "missing_title")
    return out.withColumn("observation_id", F.substring(F.sha2(F.concat_ws("|", F.col(source), F.coalesce("payload", F.col(raw), F.lit(""))), 256), 1, 20)).withColumn("normalization_error", error)


def resolved(df: DataFrame, resolution: str, url: str, kind: str, confidence: str) -> DataFrame:
    """df with what a resolver's record (JSON, any depth) says of each observation, in place of what was there before it.

    Adds resolution_attempted, resolution_error, redirect_trail (its public addresses in order),
    hydrated_source and hydrated (the fetched posting's safe payload); overrides url with the
    resolved public address. A trail that leads from one host to another proves a recorded
    original_employer where the rules alone know nothing: kind and confidence are then the record's.
    A record that can't be read changes nothing.
    """
    given = df.columns
    get = lambda path, t: F.try_variant_get("_v", path, t)
    said = lambda name: F.coalesce(F.col("_parts.nested")[name], get(f"$.{name}", "string"))
    # in steps, so that each is computed once a row however often the next one uses it
    df = df.withColumn("_parts", payloads.members(F.col(resolution)))
    df = df.withColumn("_v", F.try_parse_json("_parts.flat"))
    df = df.withColumns({"_hops": F.coalesce(get("$.redirect_trail", "array<string>"), F.array().cast("array<string>")), "_there": F.nullif(urls.sanitized(get("$.normalized_url", "string")), F.lit("")), "_kind": get("$.source_kind", "string"), "_posting": F.col("_parts.nested")["hydrated_job"]})
    df = df.withColumn("_trail", F.when(F.col("_there").isNotNull(), F.filter(F.transform("_hops", urls.sanitized), lambda u: u != "")).otherwise(F.array().cast("array<string>")))
    df = df.withColumns({"_first": urls.host(F.get("_trail", F.lit(0))), "_last": urls.host(F.coalesce("_there", F.col(url)))})
    proven = (F.size("_trail") > 0) & (F.col(kind) == "unknown") & (F.col("_kind") == "original_employer") & (F.col("_first") != "") & (F.col("_last") != "") & (F.col("_first") != F.col("_last"))
    df = df.withColumn("_proven", F.coalesce(proven, F.lit(False)))
    posting = F.col("_posting")
    out = df.withColumns(
        {
            "resolution_attempted": F.coalesce(get("$.attempted", "boolean"), F.lit(False)),
            "resolution_error": F.nullif(said("error"), F.lit("")),
            "redirect_trail": F.col("_trail"),
            "hydrated": F.when(posting.startswith("{"), posting),
            "hydrated_source": F.when(posting.startswith("{"), said("hydrated_source")),
            url: F.coalesce("_there", F.col(url)),
            kind: F.when(F.col("_proven"), F.col("_kind")).otherwise(F.col(kind)),
            confidence: F.when(F.col("_proven"), F.coalesce(get("$.source_confidence", "double"), F.col(confidence))).otherwise(F.col(confidence)),
        }
    )
    return out.select(*given, *[c for c in ("resolution_attempted", "resolution_error", "redirect_trail", "hydrated", "hydrated_source") if c not in given])


def source_kind(source: Column, tier: Column, prior: Column, host: Column, company_host: Column, ats_sources: list[str], board_sources: list[str], search_sources: list[str]) -> Column:
    """(kind, confidence): whose page an observation comes from. Rules come in order; without proof of an original it stays unknown."""
    own = (company_host != "") & ((host == company_host) | host.endswith(F.concat(F.lit("."), company_host)))
    floor = lambda least: F.greatest(F.coalesce(prior, F.lit(0.0)), F.lit(least))
    # The kinds and how sure each origin is.
    rules = [
        (source.startswith("email:"), "email_offer", F.lit(0.95)),
        (source.isin(*ats_sources), "original_ats", F.lit(0.92)),
        (tier == "farm", "content_farm", F.coalesce(prior, F.lit(0.0))),
        (source.isin(*search_sources), "aggregator_unresolved", F.lit(0.60)),
        ((tier == "employer") | own, "original_employer", floor(0.90)),
        (tier == "ats", "original_ats", floor(0.90)),
        (source.isin(*board_sources), "reputable_board", floor(0.70)),
        (tier == "board", "reputable_board", floor(0.65)),
    ]
    out = F.struct(F.lit("unknown").alias("kind"), F.coalesce(prior, F.lit(0.0)).alias("confidence"))
    for holds, kind, confidence in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(kind).alias("kind"), confidence.alias("confidence"))).otherwise(out)
    return out


def captured(df: DataFrame, kind: str, native: Column, listed: Column, truncated: Column, body: Column, as_of: Column, snippets: list[str]) -> DataFrame:
    """df with content_hash and the states of identity, content, route and vacancy of what was captured.

    A provider's own full record proves all four; anything else proves only how much text it brought.
    """
    whole = F.coalesce(native & ~F.coalesce(truncated, F.lit(False)), F.lit(False))
    closed = F.coalesce(~listed, F.lit(False))
    return df.withColumns(
        {
            "content_hash": F.sha2(F.coalesce(body, F.lit("")), 256),
            "identity_state": F.when(whole, "exact"),
            "content_state": F.when(whole, "complete").when(F.col(kind).isin(*snippets), "snippet_only").otherwise("partial"),
            "route_state": F.when(whole, "observed_public_route"),
            "vacancy_state": F.when(whole, F.when(closed, "explicitly_closed").otherwise("verified_open")),
            "verified_open_at": F.when(whole & ~closed, as_of),
        }
    )


DIMENSIONS = ("identity", "content", "vacancy", "route", "pay", "requirements", "place", "source")


def evidence_view(states: dict[str, Column]) -> Column:
    """One value a dimension, 'unknown' where nothing is known: each is judged alone, none stands for another."""
    return F.struct(*[F.coalesce(states.get(d, F.lit(None).cast("string")), F.lit("unknown")).alias(d) for d in DIMENSIONS])


def children(parents: DataFrame, lookups: DataFrame, key: str) -> DataFrame:
    """A child observation for each accepted lookup (key, final_url, body, accepted): it names its parents and takes a new identity from its own content."""
    kept = lookups.where("accepted").select(F.col(key).alias("_k"), "final_url", "body")
    out = parents.select(key, F.col("parents").alias("_old")).join(kept, F.col(key) == F.col("_k"))
    identity = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "final_url", F.sha2(F.coalesce("body", F.lit("")), 256)), 256), 1, 20)
    return out.select(identity.alias("child_id"), F.array_distinct(F.concat("_old", F.array(F.col(key)))).alias("parents"), "final_url", F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))


def counterparty(source: Column, platform: Column, company: Column, company_host: Column, url: Column, marketplaces: dict[str, str]) -> Column:
    """Who is behind a listing: a community request, a marketplace's own listing, a registry key, a company, a domain, or the listing alone.

    marketplaces: platform key -> pattern whose first group names the listing in a URL.
    """
    listing = F.coalesce(*[F.when(platform == k, F.concat(F.lit(f"marketplace:{k}:"), F.nullif(F.regexp_extract(url, p, 1), F.lit("")))) for k, p in marketplaces.items()], F.lit(None).cast("string"))
    name = F.nullif(text.identity_text(F.coalesce(company, F.lit(""))), F.lit(""))
    alone = F.concat(F.lit("listing:"), urls.host(F.coalesce(url, F.lit(""))), F.lit(":"), F.lower(F.btrim(urls.path(F.coalesce(url, F.lit(""))), F.lit("/"))))
    return F.coalesce(
        F.when(source == "community", F.concat(F.lit("community:"), urls.sanitized(url))),
        listing,
        F.concat(F.lit("registry:"), F.nullif(platform, F.lit(""))),
        F.concat(F.lit("company:"), name),
        F.concat(F.lit("domain:"), F.nullif(F.lower(company_host), F.lit(""))),
        alone,
    )


def binding_hash(*parts: Column) -> Column:
    """What ties an outcome to an observation: its id, public URL and content."""
    return F.sha2(hashing.keyed(*parts), 256)


def destination_hash(channel: Column, address: Column) -> Column:
    """A destination without its address: the channel and a hash of the trimmed, lower-cased address."""
    return F.concat(F.lower(channel), F.lit(":"), F.substring(F.sha2(F.lower(F.trim(address)), 256), 1, 16))


def run_metadata(settings: dict[str, Column]) -> Column:
    """A hash of a run's settings, in the order of their names."""
    return F.sha2(hashing.keyed(*[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("~"))) for k, v in sorted(settings.items())]), 256)


def bound(bindings: DataFrame, observations: DataFrame) -> DataFrame:
    """bindings (canonical_id, observation_id, role_url, active) with issue: null for one that names an observation of its canonical and that observation's exact URL.

    observations: canonical_id, observation_id, public_url. An issue is several_active
    (two active bindings of one canonical), unknown_canonical, unknown_observation or url_mismatch.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    several = bindings.where("active").groupBy("canonical_id").count().where("count > 1").select(F.col("canonical_id").alias("_twice"))
    known = observations.select(F.col("canonical_id").alias("_canonical")).distinct()
    seen = observations.groupBy(F.col("canonical_id").alias("_c"), F.col("observation_id").alias("_o")).agg(F.min("public_url").alias("_url"))
    out = bindings.join(several, F.col("canonical_id") == F.col("_twice"), "left").join(known, F.col("canonical_id") == F.col("_canonical"), "left")
    out = out.join(seen, (F.col("canonical_id") == F.col("_c")) & (F.col("observation_id") == F.col("_o")), "left")
    issue = scoring.first_reason({"several_active": F.col("_twice").isNotNull() & F.col("active"), "unknown_canonical": F.col("_canonical").isNull(), "unknown_observation": F.col("_o").isNull(), "url_mismatch": (bare(F.col("_url")) == "") | (bare(F.col("_url")) != bare(F.col("role_url")))}, "")
    return out.select(*bindings.columns, F.nullif(issue, F.lit("")).alias("issue"))


def adopted(holds: DataFrame, intents: DataFrame, revisions: DataFrame) -> DataFrame:
    """Holds (subject, channel) that an old receipt left, with the first revision that is queued for them: hold -> intent -> revision; those without one stay held.

    intents: intent_id, subject, channel; revisions: intent_id, revision, material_hash.
    """
    queued = intents.join(revisions, "intent_id").groupBy("subject", "channel").agg(F.min_by(F.struct("revision", "material_hash"), F.struct("revision", "intent_id")).alias("_first"))
    return holds.join(queued, ["subject", "channel"], "left").select("subject", "channel", F.col("_first.revision").alias("revision"), F.col("_first.material_hash").alias("material_hash"), F.when(F.col("_first").isNull(), "held").otherwise("adopted").alias("status"))


def schema_proofs(rows: DataFrame, proofs: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, old_hash, new_hash) with state for a destination whose material changed its schema.

    adopted if an accepted proof (keys, old_hash, new_hash) names both hashes, same if nothing changed, else held.
    """
    known = proofs.where("accepted").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("old_hash").alias("_old"), F.col("new_hash").alias("_new")).distinct()
    match = [rows[k] == known[f"_{k}"] for k in keys] + [rows["old_hash"] == known["_old"], rows["new_hash"] == known["_new"]]
    state = F.when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").when(F.col("_old").isNotNull(), "adopted").otherwise("held")
    return rows.join(known, match, "left").select(*rows.columns, state.alias("state"))
