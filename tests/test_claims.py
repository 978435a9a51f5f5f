"""Claims with spans, and whose money an amount is."""

import pytest

from evidentia.operators import claims


def found(text):
    out = list(claims.claims_of(text))
    assert all(text[a:b] for _, _, _, _, a, b, _, _, _ in out)
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("Base salary is $90,000 per year and our revenue is $5 million.", ["work", "business"]),
        ("Base salary $90,000 a year, plus a $2,000 relocation allowance.", ["work", "benefit"]),
        ("We raised $30M.", ["business"]),
        ("Earn €12.50 per hour", ["work"]),
        ("$1 million paid out to contributors", ["pool"]),
        ("Project budget: USD 400", ["budget"]),
        ("About $40 is mentioned", ["unknown"]),
        ("Pay for the other project is $99 per hour.", ["other_role"]),
        ("Salary $50-60k, insurance worth $1,000 and a salary review", ["work", "benefit"]),
        ("No money here", []),
    ],
)
def test_the_nearest_label_of_a_part_owns_an_amount(text, want):
    assert [k.removeprefix("money:") for k, *_ in found(text) if k.startswith("money:")] == want


def test_spans_sections_and_owners():
    text = "Intro.\n\nRequirements:\nMust speak Polish and French. Our customers speak Dutch.\nBenefits\nInsurance of $100; approval takes up to 3 days."
    out = found(text)
    for kind, value, _, _, a, b, *_ in out:
        assert text[a:b].strip() == text[a:b]
        if kind.startswith("money"):
            assert text[a:b] == value
    by = {k: (v, how, mode, section, who) for k, v, how, mode, _, _, section, who, _ in out if k != "language"}
    assert [(v, mode, section, who) for k, v, _, mode, _, _, section, who, _ in out if k == "language"] == [("French,Polish", "all", "requirements", "applicant"), ("Dutch", "single", "requirements", "outsider")]
    assert by["money:benefit"][3:] == ("benefits", "applicant") and by["condition:approval_processing"][3] == "benefits"


def test_conditions_take_the_nearest_amount(spark):
    texts = [
        (1, "Pay $10 per hour.\nPay\nRate is $20 per hour, paid weekly. Payment subject to approval."),
        (2, "Payments are sent monthly. Salary: $30 a month"),
        (3, "Payments are sent monthly. Revenue: $30 million"),
        (None, "We pay $7 per task. It is estimated to take 5 minutes per task."),
        (4, None),
    ]
    df = claims.span_claims(spark.createDataFrame(texts, "id long, body string"), "body")
    got = sorted((r.id or 0, r.kind.removeprefix("condition:"), r.amount, r.found) for r in claims.bound_conditions(df, "id").collect())
    assert got == [(0, "work_estimate", "$7 per task", "section"), (1, "approval_condition", "$20 per hour", "section"), (1, "payment_schedule", "$20 per hour", "clause"), (2, "payment_schedule", "$30 a month", "text"), (3, "payment_schedule", None, "none")]
