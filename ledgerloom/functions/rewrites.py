"""Prompts made into others: for generation, for scoring, and for classification of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import once, strip
from .text import PROMPT_SUFFIX

# The endings and marks of the prompts.
ANSWER_MARK = "Answer now."
CONTRACTS = {
    "two_line": "\n\nAnswer now. Return only the two requested integers on separate lines, with no labels and no explanation.\n",
    "plain": "\n\nAnswer now.\n",
}
SCORING_END = "\n\nAnswer:\n"
LABEL_TASK = (
    "Task: Determine whether the described outcome is already realized (cashed out or position closed) or still paper (open/unrealized).\n"
    "Answer now.\nReturn exactly one label: REALIZED or PAPER.\nLabel:"
)
LABEL_MARKS = ("Return exactly one label: REALIZED or PAPER", "Label:")
BEHAVIOR_TARGET = "realization_classification"
VARIANT = "single_label_realized_vs_paper_v1"
ROLE_LABELS = {"realized_closed": "REALIZED", "paper_open": "PAPER"}
_INTEGER_FORM = r"(?iu)Answer with exactly two integers on separate lines:[^.]*\."


def _rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def without_suffix(x: Column) -> Column:
    """The prompt up to the closing phrase, if it ends with that."""
    return F.when(x.endswith(PROMPT_SUFFIX), _rstrip(F.substring(x, F.lit(1), F.length(x) - len(PROMPT_SUFFIX)))).otherwise(x)


def generation(x: Column, contract: str = "two_line") -> Column:
    """The prompt that asks for an answer now; another contract raises."""
    if contract not in CONTRACTS:
        raise ValueError(f"the contract is one of {', '.join(CONTRACTS)}")
    return F.concat(without_suffix(x), F.lit(CONTRACTS[contract]))


def scoring(x: Column) -> Column:
    return F.concat(without_suffix(x), F.lit(SCORING_END))


def classification(x: Column, keep: bool = False) -> Column:
    """The prompt up to its answer mark, without forms for integers, and the task of naming a label. ``keep``: a prompt with that task stays as it is."""
    cut = once(x, lambda p: without_suffix(F.when(F.instr(p, ANSWER_MARK) > 0, _rstrip(F.substring_index(p, ANSWER_MARK, 1))).otherwise(p)))
    asked = F.concat(strip(F.regexp_replace(F.regexp_replace(cut, _INTEGER_FORM, ""), "\n{3,}", "\n\n")), F.lit(f"\n\n{LABEL_TASK}"))
    if not keep:
        return F.concat(asked, F.lit("\n"))
    return F.when(x.contains(LABEL_MARKS[0]) & x.contains(LABEL_MARKS[1]), strip(x)).otherwise(asked)


def classification_rows(prompts: DataFrame) -> DataFrame:
    """Prompts with pair_role as prompts for classification: the text and the target are replaced, the expected label and the variant added."""
    role = F.lower(strip("pair_role"))
    table = F.create_map(*[F.lit(v) for pair in ROLE_LABELS.items() for v in pair])
    return prompts.withColumns({
        "prompt_text": classification(F.coalesce("prompt_text", F.lit(""))), "behavior_target": F.lit(BEHAVIOR_TARGET),
        "classification_label_expected": F.coalesce(F.try_element_at(table, role), F.lit("")), "classification_prompt_variant": F.lit(VARIANT),
    })
