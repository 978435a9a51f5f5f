"""Markup as a stream of tags with a stack of open elements, folded in one pass over a page's tokens.

A region is what an element that is skipped encloses, however it nests. Where such a region
can't be told for sure (never closed, or an element around it closes inside) there is no
result: what follows could be either side of it.

The fold carries the open elements as two texts, those outside of a region and those of the
region it is in, and the regions. A page costs its tokens times its depth in letters; limits
(DEPTH open elements, TAGS tags) bound that, where a caller wants them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

DEPTH, TAGS = 64, 6000
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Roles of controls.
CONTROL_ROLES = ("button", "combobox", "form", "listbox", "menu", "menuitem", "navigation", "radiogroup", "textbox")
TOKEN = r"""(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[/!?a-z](?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^<]+|<"""

Skip = Callable[[Column, Column], Column]


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value within a tag, '' without one."""
    return F.trim(F.regexp_replace(F.regexp_extract(tag, f"""(?is)\\s{name}\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>]+)""", 1), "^[\"']|[\"']$", ""))


def tokens(markup: Column, skip: Skip) -> Column:
    """(kind, tag, off, n) of each tag, comment or text of markup; together they are all of it."""

    def token(t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        raw = tag.isin("script", "style") & F.lower(t).rlike(r"(?s)^<s.*</s(cript|tyle)\s*>$")
        kind = F.when(tag == "", "text").when(t.startswith("</"), "close").when(raw | tag.isin(*VOID) | t.endswith("/>"), "alone").otherwise("open")
        return F.struct(kind.alias("kind"), tag.alias("tag"), ((tag != "") & ~t.startswith("</") & skip(t, tag)).alias("off"), F.length(t).alias("n"))

    return F.transform(F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0)), token)


def regions(markup: Column, skip: Skip, limited: bool = True) -> Column:
    """(regions, fault): spans [a, b) of letters that skipped elements take up, and why they are not sure: limit (if limited), crossed, unclosed."""
    start = F.expr("struct('' as outside, '' as within, 0 as at, -1 as begin, cast(array() as array<struct<a:int,b:int>>) as spans, cast(null as string) as fault, 0 as tags)")

    def step(s: Column, t: Column) -> Column:
        end, inside, name = s["at"] + t["n"], s["within"] != "", F.concat(F.lit("<"), t["tag"], F.lit(">"))
        opens, closes = t["kind"] == "open", t["kind"] == "close"
        back = lambda c: F.left(c, F.length(c) - F.length(F.call_function("substring_index", c, name, F.lit(-1))) - F.length(name))  # noqa: E731  # without the last element of that name and those in it
        outside = F.when(opens & ~inside & ~t["off"], F.concat(s["outside"], name)).when(closes & ~inside & F.contains(s["outside"], name), back(s["outside"])).otherwise(s["outside"])
        within = F.when(opens & (inside | t["off"]), F.concat(s["within"], name)).when(closes & inside & F.contains(s["within"], name), back(s["within"])).otherwise(s["within"])
        crossed = closes & inside & ~F.contains(s["within"], name) & F.contains(s["outside"], name)
        now = within != ""
        alone = (t["kind"] == "alone") & t["off"] & ~inside
        spans = F.when(alone, F.concat(s["spans"], F.array(F.struct(s["at"].alias("a"), end.alias("b"))))).when(inside & ~now, F.concat(s["spans"], F.array(F.struct(s["begin"].alias("a"), end.alias("b"))))).otherwise(s["spans"])
        begin = F.when(inside, F.when(now, s["begin"]).otherwise(F.lit(-1))).otherwise(F.when(now, s["at"]).otherwise(F.lit(-1)))
        tags = s["tags"] + t["kind"].isin("open", "alone").cast("int")
        fault = F.when(crossed, "crossed")
        if limited:
            stack = F.concat(s["outside"], s["within"])
            fault = F.when((tags > TAGS) | (F.length(stack) - F.length(F.replace(stack, F.lit("<"))) >= DEPTH), "limit").otherwise(fault)
        after = F.struct(outside.alias("outside"), within.alias("within"), end.alias("at"), begin.alias("begin"), spans.alias("spans"), fault.alias("fault"), tags.alias("tags"))
        return F.when(s["fault"].isNull(), after).otherwise(s)

    return F.aggregate(tokens(markup, skip), start, step, lambda s: F.struct(s["spans"].alias("regions"), F.coalesce(s["fault"], F.when(s["begin"] >= 0, "unclosed")).alias("fault")))


def without(markup: Column, skip: Skip, gap: str = " ", limited: bool = True) -> Column:
    """Markup with gap in place of skipped elements; null where they are not sure."""

    def cut(r: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), F.transform(r["regions"], lambda x: x["b"]))
        ends = F.concat(F.transform(r["regions"], lambda x: x["a"]), F.array(F.length(markup)))
        return F.when(r["fault"].isNull(), F.array_join(F.zip_with(edges, ends, lambda a, b: F.substring(markup, a + 1, b - a)), gap))

    return F.get(F.transform(F.array(regions(markup, skip, limited)), cut), F.lit(0))


def is_control(names: tuple[str, ...]) -> Skip:
    """Elements of these names, or that play the role of a control."""
    return lambda t, tag: tag.isin(*names) | F.arrays_overlap(F.split(F.lower(attribute(t, "role")), r"\s+"), F.array(*[F.lit(r) for r in CONTROL_ROLES]))


def is_unseen(t: Column, tag: Column) -> Column:
    """Elements that a reader of a page's own message doesn't see or that are not its own: scripts, asides, quotes, replies, hidden ones."""
    named = F.concat_ws(" ", attribute(t, "class"), attribute(t, "id"))
    hidden = t.rlike(r"(?i)\shidden[\s=/>]") | (F.lower(attribute(t, "aria-hidden")) == "true") | attribute(t, "style").rlike(r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden)")
    return tag.isin("script", "style", "noscript", "blockquote", "aside", "nav", "template") | hidden | named.rlike("(?i)(comment|reply|quote|related)")


def decoded(markup: Column) -> Column:
    """Markup that is encoded as a whole, once or twice, decoded; an encoded example within real markup stays text."""
    c = markup
    for _ in range(2):
        c = F.when(~c.rlike("(?i)</?[a-z][^>]*>") & c.rlike("(?i)&(amp;)?lt;/?[a-z]"), text.unescaped(c)).otherwise(c)
    return c


def blocks(markup: Column) -> Column:
    """Visible text of a page, block by block; null where what is hidden is not sure."""
    seen = without(markup, is_unseen, " ", limited=False)
    cut = F.split(F.regexp_replace(seen, "(?s)<!--.*?-->", " "), r"(?i)</?(?:p|div|section|article|main|footer|h1|h2|li|br)(?:\s[^>]*)?/?>")
    return F.filter(F.transform(cut, lambda b: F.trim(F.regexp_replace(text.unescaped(F.regexp_replace(b, "<[^>]*>", " ")), r"\s+", " "))), lambda b: b != "")


def stream(markup: Column) -> Column:
    """The text that a page's scripts push for its own use, end to end; null without any."""
    pushed = F.regexp_extract_all(markup, F.lit(r"""(?s)<script(?:\s[^>]*)?>\s*self\.__next_f\.push\(\[1,\s*("(?:[^"\\]++|\\.)*+")\]\)\s*;?\s*</script\s*>"""), F.lit(1))
    texts = F.transform(pushed, lambda p: F.try_variant_get(F.try_parse_json(p), "$", "string"))
    return F.when((F.size(pushed) > 0) & ~F.exists(texts, lambda x: x.isNull()), F.array_join(texts, ""))


def stream_records(pushed: Column) -> Column:
    """Records of stream(): number -> JSON, of the lines that hold an object, a list or a text; null where a number comes twice."""
    lines = F.filter(F.split(pushed, "\n"), lambda x: x.rlike(r'^[0-9a-f]+:[\[{"]'))
    pair = lambda x: F.struct(F.regexp_extract(x, "^([0-9a-f]+):", 1).alias("key"), F.regexp_extract(x, "(?s)^[0-9a-f]+:(.*)$", 1).alias("value"))
    found = F.filter(F.transform(lines, pair), lambda e: F.try_parse_json(e["value"]).isNotNull())
    keys = F.transform(found, lambda e: e["key"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(found))
