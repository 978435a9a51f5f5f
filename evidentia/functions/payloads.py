"""Payloads of any depth as columns, by Spark's VARIANT: canonical order, redaction and safe forms.

A payload is walked level by level: objects and arrays are both lists of (name, value)
on the way, so a level costs one expression however its values mix, and are put together
again behind it. What can't be read as JSON, names one thing twice in one object, or nests
deeper than the walk, has no safe form: null.

members() knows no depth: it cuts a payload into its marks, of which Spark makes each safe
by itself, and an Arrow function puts them in order with a stack.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import structured, urls
from .scoring import let

REDACTED = "[redacted]"
DEPTH = 8
#: What members() cuts JSON into: texts (names with their colon), brackets and commas, everything else between them; a lone quote or colon is a mark too, so that nothing but white space goes.
MARK = r'(?s)"(?:[^"\\]++|\\.)*+"(?:[ \t\r\n]*+:)?+|[{}\[\],]|[^ \t\r\n{}\[\],:"]++|[:"]'
#: Marks that may be a value; Spark's parser would take a word whatever stands right behind it.
ALONE = r'^(?:[-"0-9]|(?:true|false|null)\z)'
#: Names whose values are secrets wherever they stand.
SECRET_NAMES = (*urls.SECRET, "api-key", "apikey", "app_id", "app_key", "appid", "appkey", "authorization", "client_secret", "cookie", "private_key", "refresh_token", "secret", "x-api-key")


def canonical(raw: Column) -> Column:
    """JSON with the names of all objects in order, at every depth; null for what is no JSON or repeats a name in one object."""
    return F.to_json(F.try_parse_json(raw))


def canonical_object(raw: Column) -> Column:
    """canonical() of objects alone."""
    return F.when(structured.is_object(raw), canonical(raw))


def redacted(value: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Text without credentials: values of secret query names, authorization and key headers, bot addresses, and the given secrets of six letters or more."""
    names = "|".join(n.replace("-", "[-_]") for n in SECRET_NAMES)
    out = F.regexp_replace(value, f"(?i)([?&](?:{names})=)[^&#\\s\"']+", f"$1{REDACTED}")
    out = F.regexp_replace(out, "(?i)\\b(authorization\\s*[:=]\\s*(?:(?:bearer|basic)\\s+)?)[^,;\\s\"']+", f"$1{REDACTED}")
    out = F.regexp_replace(out, "(?i)\\b((?:x-[a-z]+-|x-)?api-key\\s*[:=]\\s*)[^,;\\s\"']+", f"$1{REDACTED}")
    out = F.regexp_replace(out, "(?i)(://[^/\\s]+/bot)[^/\\s?#]+", f"$1{REDACTED}")
    for s in sorted((s for s in secrets if len(s) >= 6), key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit(REDACTED))
    return out


def safe_text(value: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Redacted text; a text that is a web address as a whole takes its public form."""
    clean = redacted(value, secrets)
    return F.when(F.lower(F.trim(value)).rlike("^https?://"), urls.sanitized(F.trim(value))).otherwise(clean)


def part(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def walked(v: Column, depth: int, leaf, named) -> Column:
    """The variant v with leaf(text) in place of its texts, and named(name, variant) of what stands under a name in place of it, where that is not null."""
    text = F.when(F.to_json(v).startswith('"'), leaf(part(v, "string")).cast("variant")).otherwise(v)
    if depth == 0:
        return text
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))

    # what is used twice goes through let(), as each level within it would double its cost
    def inner(n: Column) -> Column:
        entries = F.coalesce(F.transform(F.map_entries(n["fields"]), lambda e: pair(e["key"], e["value"])), F.transform(n["items"], lambda x: pair(F.lit(None).cast("string"), x)))
        new = F.transform(entries, lambda e: pair(e["name"], F.coalesce(named(e["name"], e["value"]), walked(e["value"], depth - 1, leaf, named))))
        whole = lambda x: F.when(n["fields"].isNotNull(), F.to_variant_object(F.map_from_entries(x))).otherwise(F.to_variant_object(F.transform(x, lambda e: e["value"])))
        return F.when(n["fields"].isNotNull() | n["items"].isNotNull(), let(new, whole)).otherwise(text)

    return let(F.struct(part(v, "map<string,variant>").alias("fields"), part(v, "array<variant>").alias("items")), inner)


def sanitized(raw: Column, secrets: tuple[str, ...] = (), names: tuple[str, ...] = SECRET_NAMES, depth: int = DEPTH) -> Column:
    """canonical() without secrets: what stands under a secret name goes, whatever it is; texts are safe_text()."""
    hide = lambda name, _: F.when(F.lower(name).isin(*names), F.lit(REDACTED).cast("variant"))
    return F.when(structured.depth(raw) <= depth, F.to_json(let(F.try_parse_json(raw), lambda v: walked(v, depth, lambda t: safe_text(t, secrets), hide))))


def text_of(value: str | list) -> str:
    """The marks of a value, end to end; a list holds those of an object or an array."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x))
    return "".join(out)


def ordered(entries: list[tuple[str, str | list]], names: tuple[str, ...]) -> list[tuple[str, str | list]] | None:
    """An object's (mark of a name, value) in Spark's order of the names, without secrets; null if a name comes twice."""
    named = {(m[1:-2] if "\\" not in m else json.loads(m[:-1])): (m, value) for m, value in entries}
    if len(named) < len(entries):
        return None
    hidden = json.dumps(REDACTED)
    return [(m, hidden if name.lower() in names else value) for name, (m, value) in sorted(named.items(), key=lambda e: e[0].encode("utf-16-be"))]


def top_members(marks: str | None, names: tuple[str, ...]) -> tuple[str, dict[str, str]] | None:
    """members() of marks, one a line and '' for what is none; what follows the first value is not looked at, as Spark's parsers don't."""
    if not marks or marks[0] != "{":
        return None
    stack: list[tuple[str, str, list]] = []  # open values: what closes each, the mark of its name ('' in an array), its entries
    want, name = "value", ""
    for m in marks.split("\n"):
        named = bool(stack) and stack[-1][0] == "}"
        if m == ",":
            if want != "more":
                return None
            want = "name" if named else "value"
        elif m in ("}", "]"):
            if want not in ("first", "more") or m != stack[-1][0]:
                return None
            _, name, entries = stack.pop()
            if named and (entries := ordered(entries, names)) is None:
                return None
            if not stack:
                plain = [(k, v if isinstance(v, str) else text_of(["null" if isinstance(x, list) else x for x in v])) for k, v in entries if v[0] != "{"]
                return "{" + ",".join(k + v for k, v in plain) + "}", {json.loads(k[:-1]): text_of(v) for k, v in entries if isinstance(v, list)}
            inner = [x for k, v in entries for x in (",", k, v)][1:]
            stack[-1][2].append((name, ["{" if named else "[", *inner, m]))
            want, name = "more", ""
        elif m.endswith(":"):
            if not named or want not in ("first", "name"):
                return None
            want, name = "value", m
        elif m == "" or (want != "value" and (named or want != "first")):
            return None
        elif m in ("{", "["):
            stack.append(("}" if m == "{" else "]", name, []))
            want, name = "first", ""
        else:
            stack[-1][2].append((name, m))
            want, name = "more", ""
    return None


def members(raw: Column, secrets: tuple[str, ...] = (), names: tuple[str, ...] = SECRET_NAMES) -> Column:
    """(flat, nested) of a JSON object of any depth, each value as sanitized() has it; null for anything else.

    flat: the object with its texts, numbers and the like, and its arrays of such; what nests
    within them is null there. nested: the JSON of each object and array, by its name.
    """

    def safe(m: Column) -> Column:
        is_name, v = m["mark"].endswith(":"), m["value"]
        text = F.when(m["mark"].startswith('"') & ~is_name, safe_text(part(v, "string"), secrets).cast("variant")).otherwise(v)
        return F.when(m["mark"].isin(*"{}[],"), m["mark"]).otherwise(F.concat(F.to_json(text), F.when(is_name, ":").otherwise("")))

    # two passes, as Spark can't place a Python function whose argument has a lambda that reads another one's variable
    marks = F.transform(F.regexp_extract_all(raw, F.lit(MARK), F.lit(0)), lambda t: F.struct(t.alias("mark"), F.when(t.rlike(ALONE), F.try_parse_json(t)).alias("value")))

    @F.udf("flat string, nested map<string,string>", useArrow=True)
    def put(marks):
        return top_members(marks, names)

    return put(F.array_join(F.transform(marks, safe), "\n", ""))


def fault(raw: Column, depth: int = DEPTH) -> Column:
    """Why a payload has no safe form: malformed (not one JSON object alone, or a name twice), too_deep; else null."""
    return F.when(~structured.is_object(raw), "malformed").when(structured.depth(raw) > depth, "too_deep")
