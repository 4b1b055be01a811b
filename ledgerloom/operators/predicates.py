"""Row predicates and derived columns of trial, prompt and steering tables. Each returns a Column or a lazily filtered DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce


def list_argument(text: str | None) -> list[str] | None:
    """The distinct parts of a comma-separated argument in order; None, that is no filter, if there are none."""
    return list(dict.fromkeys(x for x in (p.strip() for p in (text or "").split(",")) if x)) or None


def scales_argument(text: str) -> list[float]:
    """The distinct numbers of a comma-separated argument, ascending."""
    return sorted({float(x) for x in text.split(",") if x.strip()})


def among(df: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose trimmed value is among ``include``, if given, and not among ``exclude``; blank values are values."""
    value = coerce.strip(column)
    out = df if include is None else df.where(value.isin(include))
    return out if exclude is None else out.where(~value.isin(exclude))


def of_block(df: DataFrame, model: str | None = None, temperature: str | float | None = None, version: str | None = None) -> DataFrame:
    """Rows of the given block parts; temperatures are compared as numbers, so ``1`` finds ``1.0``."""
    if model is not None:
        df = df.where(coerce.strip("model") == model)
    if temperature is not None:
        df = df.where(coerce.temperature_key("temperature") == coerce.temperature_key(F.lit(str(temperature))))
    return df if version is None else df.where(coerce.strip("prompt_version") == version)


def regression_frame(trials: DataFrame, measure: str, model: str | None = None, version: str | None = None, valid: str = "valid") -> DataFrame:
    """Valid trials with a finite measure, of one model and prompt version if asked for; the measure becomes a double.

    Raises if a column is missing or no row is left.
    """
    if missing := [c for c in ("condition", "outcome_type", "model", "temperature", "prompt_version", "parsed_wager", valid, measure) if c not in trials.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    own = trials.where(coerce.true_exact(valid)).withColumn(measure, finite(coerce.number(measure))).dropna(subset=[measure])
    own = own if model is None else own.where(F.col("model") == model)
    own = own if version is None else own.where(F.col("prompt_version") == version)
    if own.isEmpty():
        raise ValueError("no valid rows are left")
    return own


def finite(x: Column | str) -> Column:
    """The number, or null if it is infinite or no number."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def indicators(df: DataFrame, condition: str = "condition", amount: str = "amount") -> DataFrame:
    """Adds is_loss, is_gain, is_realized (0 or 1), abs_amount, log_abs_amount and their products with is_realized."""
    c, a = F.lower(condition), F.abs(F.col(amount).cast("double"))
    has = lambda word: c.contains(word).cast("int")
    own = df.withColumns({"is_loss": has("loss"), "is_gain": has("gain"), "is_realized": c.startswith("realized").cast("int"), "abs_amount": a, "log_abs_amount": F.log1p(a)})
    return own.withColumns({f"{x}_realized": F.col(x) * F.col("is_realized") for x in ("is_loss", "is_gain", "log_abs_amount")})


def domain_of(condition: Column | str) -> Column:
    """``realized`` or ``paper`` by the name's start."""
    return F.when(F.col(condition).startswith("realized") if isinstance(condition, str) else condition.startswith("realized"), "realized").otherwise("paper")


def valence_of(condition: Column | str) -> Column:
    """gain or neutral if the name says so; everything else is a loss, also a name that ends in even."""
    c = F.col(condition) if isinstance(condition, str) else condition
    return F.when(c.contains("gain"), "gain").when(c.contains("neutral"), "neutral").otherwise("loss")


def sign_label(scale: Column | str, names: tuple[str, str, str] = ("positive", "negative", "baseline")) -> Column:
    s = F.col(scale) if isinstance(scale, str) else scale
    return F.when(s > 0, names[0]).when(s < 0, names[1]).otherwise(names[2])


def expected_label(role: Column | str) -> Column:
    """The label that a pair's role stands for; blank for other roles."""
    r = F.lower(coerce.strip(role))
    return F.when(r.isin("realized", "closed"), "REALIZED").when(r.isin("paper", "open"), "PAPER").otherwise("")


def both_valid(wager_valid: str, risk_valid: str) -> Column:
    return coerce.true_stripped(wager_valid) & coerce.true_stripped(risk_valid)


def first_filled(*cells: Column | str) -> Column:
    """The first cell that is neither null nor empty; empty if none is."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cells], F.lit(""))


def percent(rate: str) -> Column:
    return F.col(rate) * 100.0


def mapped(x: str, values: dict[str, str]) -> Column:
    """A value's name in a report; null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col(x))


def interval(coef: str, se: str, z: float = 1.96) -> tuple[Column, Column]:
    return F.col(coef) - z * F.col(se), F.col(coef) + z * F.col(se)


def searched(df: DataFrame, words: str, columns: list[str], status: str = "all") -> DataFrame:
    """Rows whose columns together contain ``words`` in any case, and that are complete or not if ``status`` says so.

    Complete: nothing remaining, a fine schema and no error.
    """
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    complete = (F.col("remaining") == 0) & F.col("schema_ok") & (F.coalesce("error", F.lit("")) == "")
    out = df.where(text.contains(words.lower()))
    return out if status == "all" else out.where(complete if status == "complete" else ~complete)
