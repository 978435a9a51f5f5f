"""Claims with spans: what a text says of languages, places, credentials, voices, experience, money and conditions, and where.

A Python table function reads a text once and yields its claims; each quotes its span word
for word. Whose money an amount is follows from the nearest label within its own part of a
clause. Conditions are then bound to money by intervals, in the DataFrame: to an amount of the
same clause, else to the nearest work amount before it in the same section, else to the
first work amount of the text.

Null and empty texts have no claims. Offsets count characters. Words and patterns are this
library's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("Arabic", "Chinese", "Dutch", "English", "French", "German", "Hindi", "Italian", "Japanese", "Korean", "Polish", "Portuguese", "Russian", "Spanish", "Turkish")
CREDENTIALS = {"bachelor": r"bachelor(?:'s)?|b\.?sc|undergraduate degree", "master": r"master(?:'s)? degree|m\.?sc", "doctorate": r"ph\.?d|doctorate", "license": r"licen[sc]ed?|licensure|board[- ]certified", "certificate": r"certificat(?:e|ion)"}
VOICE = r"voice (?:recordings?|samples?|acting|talent)|record(?:ing)? your (?:own )?voice|speech (?:samples?|recordings?)"
PLACE = r"(?:based|located|living|resid(?:e|ing)|residents?) (?:only )?(?:in|of) (?P<a>[A-Z][\w-]*(?: [A-Z][\w-]*)*)|(?P<b>[A-Z][\w-]*(?: [A-Z][\w-]*)*) residents only"
HEADING = re.compile(r"(?im)^[ \t#*]*(requirements|qualifications|responsibilities|compensation|pay|salary|benefits|about us|who we are)[ \t*]*:?[ \t*]*$")
CLAUSE = re.compile(r"\n|[;!?]|\.(?=\s|$)")
MONEY = re.compile(r"(?i)(?:[$€£₹]|\b(?:USD|EUR|GBP|INR)\b)\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:k|m|million|billion)\b)?(?:\s?(?:-|–|to)\s?(?:[$€£₹]\s?)?\d[\d,]*(?:\.\d+)?(?:\s?(?:k|m|million|billion)\b)?)?(?:\s?(?:per|an?|/)\s?(?:labor )?(?:hour|hr|month|year|annum|week|task))?")
#: Label words -> whose money they name; the nearest one governs.
LABELS = {
    "work": r"salary|wages?|pay|compensation|rate|earn|remuneration",
    "budget": r"(?:project )?budget",
    "business": r"revenues?|funding|valuation|raised|turnover|investors?",
    "benefit": r"bonus|allowance|stipend|reimbursement|insurance|equity|grant",
    "pool": r"paid out|payouts|to (?:all |our )?contributors",
}
LABEL = re.compile("(?i)" + "|".join(rf"\b(?P<{k}>{p})\b" for k, p in LABELS.items()))
JOINT = re.compile(r"(?i),\s*(?:(?:and|but|while|plus)\s+)?|\s+(?:and|but|while|whereas|plus)\s+")
OTHER_ROLE = re.compile(r"(?i)\b(?:other|another|different|previous) (?:role|project|assignment|position)s?\b")
OUTSIDER = re.compile(r"(?i)\b(?:our|the) (?:customers?|clients?|users?|team|founders?)\b")
APPLICANT = re.compile(r"(?i)\b(?:you|your|applicants?|candidates?|must|required?|fluent|native)\b")
CONDITIONS = (
    ("payment_schedule", re.compile(r"(?i)\b(?:paid|payments?|payouts?|invoices?)\b.{0,40}\b(?:weekly|monthly|bi-?weekly|every|within|net[- ]?\d+|days?)\b")),
    ("approval_condition", re.compile(r"(?i)\b(?:pay(?:ment)?|compensation)\b.{0,60}\b(?:subject to|depends? on|requires?|after) approval\b")),
    ("approval_processing", re.compile(r"(?i)\b(?:approval|review)\b.{0,30}\b(?:takes?|lasts?|within|up to)\b.{0,20}\b\d+ (?:hours?|days?|weeks?)\b")),
    ("work_estimate", re.compile(r"(?i)\b(?:estimated?|expect(?:ed)?|about|approximately)\b.{0,30}\b\d+ (?:minutes?|hours?)\b.{0,20}\b(?:per|each|a) (?:task|file|item)\b")),
)
MODALITIES = (
    ("negated", re.compile(r"(?i)\b(?:no|not|without)\b[^.]{0,40}\b(?:required|needed|necessary)\b")),
    ("optional", re.compile(r"(?i)\b(?:optional|not mandatory)\b")),
    ("preferred", re.compile(r"(?i)\b(?:preferred|a plus|nice to have|ideally|advantage)\b")),
    ("required", re.compile(r"(?i)\b(?:must|required?|needed|mandatory|essential|only)\b")),
)
#: What a match of a pattern above must hold, in small letters; finding these costs a fraction of what the pattern does, and most clauses hold none.
NEEDED = {
    "location": ("based", "located", "living", "resid"),
    "bachelor": ("bachelor", "bsc", "b.sc", "undergraduate"),
    "master": ("master", "msc", "m.sc"),
    "doctorate": ("phd", "ph.d"),
    "license": ("licen", "certified"),
    "certificate": ("certificat",),
    "voice": ("voice", "record", "speech"),
    "experience": ("year",),
    "money": ("$", "€", "£", "₹", "usd", "eur", "gbp", "inr"),
    "payment_schedule": ("paid", "payment", "payout", "invoice"),
    "approval_condition": ("approval",),
    "approval_processing": ("approval", "review"),
    "work_estimate": ("minute", "hour"),
}
DIGIT = re.compile(r"\d")
VOICES = re.compile(rf"(?i)\b(?:{VOICE})\b")
YEARS = re.compile(r"(?i)\b(\d+)\s?\+?\s?(?:(?:-|–|to)\s?(\d+)\s?)?years?\b")
NAMED = {k: re.compile(rf"(?i)\b(?:{p})\b") for k, p in CREDENTIALS.items()}
#: Letters that patterns without regard to case take for i, k and s.
FOLDED = str.maketrans("\u0130\u0131\u212a\u017f", "iiks")


def small(text: str) -> str:
    """Text in small letters, as patterns without regard to case read it."""
    return (text if text.isascii() else text.translate(FOLDED)).lower()


def modality(clause: str) -> str:
    return next((name for name, pattern in MODALITIES if pattern.search(clause)), "mentioned")


def owner(clause: str) -> str:
    """Whom a clause speaks of: other_role, outsider (customers, the team), else applicant."""
    if OTHER_ROLE.search(clause):
        return "other_role"
    return "outsider" if OUTSIDER.search(clause) and not APPLICANT.search(clause) else "applicant"


def parts(clause: str, amounts: list[re.Match]) -> Iterator[tuple[int, int]]:
    """A clause cut at the joints between its amounts, where the part behind a joint has a label of its own."""
    cuts, at = [], 0
    for a, b in zip(amounts, amounts[1:]):
        between = [j for j in JOINT.finditer(clause, a.end(), b.start())]
        after = b.end() if b is amounts[-1] else amounts[amounts.index(b) + 1].start()
        if between and LABEL.search(clause, between[0].end(), len(clause) if b is amounts[-1] else after):
            cuts.append((between[0].start(), between[0].end()))
    for start, end in cuts:
        yield at, start
        at = end
    yield at, len(clause)


def scope(clause: str, amount: re.Match, left: int, right: int) -> str:
    """Whose money an amount is: the nearest label in its part, one before it before one as near behind it."""
    found = [((amount.start() - m.end()) * 2 if m.end() <= amount.start() else (m.start() - amount.end()) * 2 + 1, m.lastgroup) for m in LABEL.finditer(clause, left, right) if m.end() <= amount.start() or m.start() >= amount.end()]
    return min(found)[1] if found else "unknown"


def claims_of(text: str) -> Iterator[tuple[str, str, str, str, int, int, str, str, int]]:
    """(kind, value, modality, mode, begin, end, section, actor, clause) for each claim of a text, in its order."""
    headings = [(m.end(), m[1].lower()) for m in HEADING.finditer(text)]
    edges = [0, *[m.end() for m in CLAUSE.finditer(text)], len(text)]
    passed, section = 0, ""
    for number, (left, right) in enumerate(zip(edges, edges[1:])):
        raw = text[left:right]
        begin = left + len(raw) - len(raw.lstrip())
        clause = text[begin : left + len(raw.rstrip())]
        if not clause or HEADING.fullmatch(clause):
            continue
        while passed < len(headings) and headings[passed][0] <= begin:
            passed, section = passed + 1, headings[passed][1]
        for kind, value, mode, a, b, who in stated(clause):
            yield kind, value, modality(clause), mode, begin + a, begin + b, section, who, number


def stated(clause: str) -> Iterator[tuple[str, str, str, int, int, str]]:
    """(kind, value, mode, begin, end, actor) for each claim of a clause, in its order."""
    low, end = small(clause), len(clause)
    may = lambda name: any(w in low for w in NEEDED[name])
    many = lambda found: "single" if len(found) == 1 else "any" if re.search(r"\bor\b", clause) else "all"
    found = []
    languages = [w for w in LANGUAGES if w in clause and re.search(rf"\b{w}\b", clause)]
    if languages:
        found.append(("language", ",".join(languages), many(languages), 0, end))
    if may("location"):
        found += [("location", m["a"] or m["b"], "single", m.start(), m.end()) for m in re.finditer(PLACE, clause)]
    credentials = [k for k, p in NAMED.items() if may(k) and p.search(clause)]
    if credentials:
        found.append(("credential", ",".join(credentials), many(credentials), 0, end))
    if may("voice"):
        found += [("voice", m[0].lower(), "single", m.start(), m.end()) for m in VOICES.finditer(clause)]
    if may("experience") and DIGIT.search(clause):
        found += [("experience", f"{int(m[1])}-{int(m[2] or m[1])}", "single", m.start(), m.end()) for m in YEARS.finditer(clause)]
    amounts = list(MONEY.finditer(clause)) if may("money") and DIGIT.search(clause) else []
    condition = next((n for n, p in CONDITIONS if may(n) and p.search(clause)), None)
    if not (found or amounts or condition):
        return
    who = owner(clause)
    for x in found:
        yield *x, who
    for a, b in parts(clause, amounts) if amounts else ():
        for m in amounts:
            if a <= m.start() < b:
                yield "money:other_role" if who == "other_role" else f"money:{scope(clause, m, a, b)}", m[0], "single", m.start(), m.end(), who
    if condition and who != "other_role":
        yield f"condition:{condition}", clause, "single", 0, end, who


@F.udtf(returnType="kind string, value string, modality string, mode string, begin int, end int, section string, actor string, clause int")
class Claims:
    """The claims of a text."""

    def eval(self, text: str):
        yield from claims_of(text or "")


def span_claims(df: DataFrame, body: str) -> DataFrame:
    """df with a row for each claim of its body; rows without claims go."""
    return df.lateralJoin(Claims(F.col(body).outer()))


def bound_conditions(claims: DataFrame, key: str) -> DataFrame:
    """Conditions of claims (key, kind, begin, end, section, clause, value) with the work amount that each is about: amount, amount_begin and how it was found (clause, section, text, none).

    Amounts of other roles, companies and benefits bind nothing. The claims are read once: all amounts
    of one text meet its conditions as a list, which a text's length bounds.
    """
    money, condition = F.col("kind").isin("money:work", "money:budget"), F.col("kind").startswith("condition:")
    amount = F.struct(F.col("begin").alias("amount_begin"), F.col("value").alias("amount"), F.col("clause").alias("clause"), F.col("section").alias("section"))
    near = lambda m: F.when(F.col("clause") == m["clause"], 0).when((F.col("section") == m["section"]) & (m["amount_begin"] <= F.col("begin")), 1).otherwise(2)
    far = lambda m: F.when(near(m) == 2, m["amount_begin"]).otherwise(F.abs(F.col("begin") - m["amount_begin"]))
    ranked = F.transform("_amounts", lambda m: F.struct(near(m).alias("near"), far(m).alias("far"), m["amount_begin"].alias("amount_begin"), m["amount"].alias("amount")))
    met = claims.where(money | condition).withColumn("_amounts", F.collect_list(F.when(money, amount)).over(Window.partitionBy(key)))
    best = met.where(condition).withColumn("_best", F.array_min(ranked))
    found = F.when(F.col("_best").isNull(), "none").otherwise(F.get(F.array(F.lit("clause"), F.lit("section"), F.lit("text")), F.col("_best.near")))
    return best.select(*claims.columns, F.col("_best.amount").alias("amount"), F.col("_best.amount_begin").alias("amount_begin"), found.alias("found"))
