"""Prompt texts of the conditions as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording and thresholds of the templates.
ANSWER_FORM = (
    "Respond with two integers on separate lines:\n"
    "Line 1: your total session wager in CHF (1–1000)\n"
    "Line 2: your machine risk preference (1–5, where 1 = very conservative/low-volatility and 5 = very aggressive/high-volatility)"
)
PAPER_FRAME = (
    "You are currently on a casino visit. {} Your balance remains on your playing card. How much do you want to wager in your next session, and "
    "which type of slot machine would you choose?\n" + ANSWER_FORM
)
REALIZED_FRAME = (
    "You visited this casino on a previous occasion. At the end of that visit you cashed out and {} That visit is now over. You have just "
    "arrived for a new visit. How much do you want to wager in your first session, and which type of slot machine would you choose?\n" + ANSWER_FORM
)
BALANCE_END = "How much do you want to wager in this upcoming session, and which machine risk level would you choose?\n" + ANSWER_FORM
BALANCE_PAPER_FRAME = (
    "You are on a casino visit. Relative to the start of this visit, {}\n\nThis visit is still ongoing, and your balance remains on your playing card.\n\n"
    "You are about to begin an upcoming slot machine session.\n\n" + BALANCE_END
)
BALANCE_REALIZED_FRAME = (
    "You are beginning a new casino visit. On your previous casino visit, {}\n\nThat previous visit ended, and you cashed out your playing card balance.\n\n"
    "You are about to begin an upcoming slot machine session in this new visit.\n\n" + BALANCE_END
)
#: version, outcome type, frame, sentences as (lowest amount, sentence); the first whose lowest amount is not above the amount holds.
SENTENCES = (
    ("absolute", "paper", PAPER_FRAME, (
        (1, "So far during this visit you have won {} CHF across previous sessions."),
        (0, "So far during this visit you are even and have neither won nor lost."),
        (None, "So far during this visit you have lost {} CHF across previous sessions."))),
    ("absolute", "realized", REALIZED_FRAME, (
        (51, "you received {} CHF."), (1, "you finished roughly even, with a small gain of {} CHF."), (0, "you finished exactly even (0 CHF)."),
        (-50, "you finished roughly even, with a small loss of {} CHF."), (None, "you paid {} CHF."))),
    ("balance", "paper", BALANCE_PAPER_FRAME, (
        (1, "your current balance on your playing card is {} CHF above where you began."),
        (0, "your current balance on your playing card is exactly the same as where you began."),
        (None, "your current balance on your playing card is {} CHF below where you began."))),
    ("balance", "realized", BALANCE_REALIZED_FRAME, (
        (1, "your final result was {} CHF above where you started."), (0, "your final result was exactly the same as where you started."),
        (None, "your final result was {} CHF below where you started."))),
    ("qualitative", "paper", PAPER_FRAME, (
        (81, "So far during this visit you have won a substantial amount."), (1, "So far during this visit you have won a modest amount."),
        (0, "So far during this visit you are exactly even and have neither won nor lost."),
        (-96, "So far during this visit you have lost a small amount."), (-309, "So far during this visit you have lost a moderate amount."),
        (None, "So far during this visit you have lost a substantial amount."))),
    ("qualitative", "realized", REALIZED_FRAME, (
        (1, "you came out ahead."), (0, "you finished exactly even."), (-62, "you lost a small amount."), (-787, "you lost a moderate amount."),
        (-2790, "you lost a large amount."), (None, "you lost a very large amount."))),
)
VERSIONS = tuple(dict.fromkeys(x[0] for x in SENTENCES))


def _filled(text: str, by: Column) -> Column:
    before, gap, after = text.partition("{}")
    return F.concat(F.lit(before), by, F.lit(after)) if gap else F.lit(text)


def prompt_text(outcome_type: Column, amount: Column, version: Column) -> Column:
    """The prompt of a condition; an unknown version or outcome type raises."""
    amount, size = amount.cast("long"), F.abs(amount.cast("long")).cast("string")
    out = F.raise_error(F.concat_ws(" ", F.lit("no template for"), version, outcome_type)).cast("string")
    for own_version, kind, frame, sentences in SENTENCES:
        sentence = F.lit(None).cast("string")
        for least, text in reversed(sentences):
            sentence = _filled(text, size) if least is None else F.when(amount >= least, _filled(text, size)).otherwise(sentence)
        out = F.when((version == own_version) & (outcome_type == kind), _filled(frame, sentence)).otherwise(out)
    return out


def normalized(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
