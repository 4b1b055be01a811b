"""Coercion of text cells: truth, numbers, keys, identities. Every rule has its own named function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number whose key is its own start: at most 7 digits before the point and 4 after it, zeros at the end left out.
_SHORT = r"^(?:0|[1-9][0-9]{0,6})(?=(?:\.0*)?\z)|^(?:0|[1-9][0-9]{0,6})\.[0-9]{0,3}[1-9](?=0*\z)"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with ``x`` evaluated once: what ``f`` gets is a lambda's variable, so a long ``x`` isn't copied to each place where ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end; null is empty."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\s+|\s+$", "")


def true_exact(x: Column | str) -> Column:
    """``true`` in any case, nothing trimmed: the rule of trial loaders."""
    return F.lower(F.coalesce(_c(x), F.lit(""))) == "true"


def true_report(x: Column | str) -> Column:
    """``true``, ``1`` or ``yes``, nothing trimmed: the rule of report tables."""
    return F.lower(F.coalesce(_c(x), F.lit(""))).isin("true", "1", "yes")


def true_stripped(x: Column | str) -> Column:
    """``true`` after trimming: the rule of steering and pair tables."""
    return F.lower(strip(x)) == "true"


def number(x: Column | str) -> Column:
    """A double, or null where the text is no number. Java's suffixes d and f are no numbers here."""

    def of(own: Column) -> Column:
        named = F.lower(F.regexp_replace(own, "^[+-]", ""))
        special = F.when(named.isin("inf", "infinity"), F.when(own.startswith("-"), float("-inf")).otherwise(float("inf"))).when(named == "nan", float("nan"))
        return F.when(own.rlike(_NUMBER), own.try_cast("double")).otherwise(special)

    return once(strip(x), of)


def strict_number(x: Column | str) -> Column:
    """A double; a text that is no number raises."""
    return F.coalesce(number(x), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(_c(x), F.lit("null")))).cast("double"))


def run_number(x: Column | str) -> Column:
    """A positive integer, else 0. ``1.0`` is no integer."""
    of = lambda own: F.when(own.rlike("^[+-]?[0-9]+$"), F.greatest(F.coalesce(own.try_cast("long"), F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return once(strip(x), of)


def temperature_key(x: Column | str) -> Column:
    """The number in at most 12 significant digits without trailing zeros; empty if it is no number. One match finds the key of most."""

    def shorter(parts: Column) -> Column:
        m = parts["m"]
        return F.concat(F.when(F.instr(m, ".") > 0, F.regexp_replace(m, r"\.?0+$", "")).otherwise(m), parts["e"])

    def of(n: Column) -> Column:
        v = n["v"]
        split = lambda text: F.struct(F.regexp_extract(text, "^([^e]*)", 1).alias("m"), F.regexp_extract(text, "(e.*)$", 1).alias("e"))
        # the pattern's smallest plain number is 1e-4 on both sides; below 1e15 Java writes all digits
        plain = once(once(F.format_string("%.12g", v), split), shorter)
        zero = F.when(n["own"].startswith("-"), "-0").otherwise("0")
        special = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").when(v == 0, zero)
        return F.when(v.isNull(), "").otherwise(F.coalesce(special, plain))

    any_number = lambda own: once(F.struct(own.alias("own"), number(own).alias("v")), of)
    return once(once(strip(x), lambda own: F.struct(own.alias("own"), F.regexp_extract(own, _SHORT, 0).alias("short"))), lambda n: F.when(n["short"] != "", n["short"]).otherwise(any_number(n["own"])))


def comparison_cell(x: Column | str) -> Column:
    """A cell for comparison: integral numbers print as integers, so ``5.0`` equals ``5``."""

    def of(n: Column) -> Column:
        v = n["v"]
        whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
        return F.when(whole, v.cast("long").cast("string")).when(v.isNotNull() & ~F.isnan(v), v.cast("string")).otherwise(n["own"])

    return once(once(strip(x), lambda own: F.struct(own.alias("own"), number(own).alias("v"))), of)


def block_selector(model: str = "model", temperature: str = "temperature", version: str = "prompt_version") -> Column:
    """(model, temperature key, version), null if any part is blank: the key by which blocks merge."""
    key = F.struct(strip(model).alias("model"), temperature_key(temperature).alias("temperature"), strip(version).alias("prompt_version"))
    return once(key, lambda k: F.when((k["model"] != "") & (k["temperature"] != "") & (k["prompt_version"] != ""), k))


def partition_key(model: str = "model", temperature: str = "temperature", version: str = "prompt_version") -> Column:
    """(model, temperature as written, version): the key by which blocks are partitioned. ``1`` and ``1.0`` differ here."""
    return F.struct(strip(model).alias("model"), strip(temperature).alias("temperature"), strip(version).alias("prompt_version"))


def identity() -> Column:
    """The key of a trial: its run if that is complete, else its request, else the row itself."""
    fields = {"c": strip("condition"), "m": strip("model"), "v": strip("prompt_version"), "t": temperature_key("temperature"), "n": run_number("run_number"), "r": strip("request_id")}
    return once(F.struct(*[x.alias(name) for name, x in fields.items()]), lambda k: identity_of(*[k[x] for x in fields]))


def identity_of(c: Column, m: Column, v: Column, t: Column, n: Column, r: Column) -> Column:
    """``identity`` of a row whose condition, model, version, temperature, run and request are stripped or numbers already."""
    run = F.when((c != "") & (n > 0) & (m != "") & (t != "") & (v != ""), F.array(F.lit("run"), c, n.cast("string"), m, t, v))
    request = F.when(r != "", F.array(F.lit("request_id"), r))
    row = F.array(F.lit("row"), c, strip("run_number"), m, t, v, strip("timestamp"), F.coalesce("response_text", F.lit("")))
    return F.coalesce(run, request, row)


def quality() -> Column:
    """What makes one of two equal trials better, from the first field on."""
    has = lambda x: F.coalesce(x, F.lit("")).rlike(r"(?U)\S").cast("int")  # noqa: E731  what ``strip`` leaves is not empty
    return F.struct(
        has("request_id").alias("request"), has("timestamp").alias("time"), has("parsed_wager").alias("wager"), has("risk_profile").alias("risk"),
        F.length(F.coalesce("response_text", F.lit(""))).alias("length"),
    )


def _slug(x: Column, bad: str, by: str, edge: str, empty: Column) -> Column:
    own = F.regexp_replace(F.regexp_replace(x, bad, by), f"^[{edge}]+|[{edge}]+$", "")
    return F.coalesce(F.nullif(own, F.lit("")), empty)


def slug_file(x: Column | str) -> Column:
    return _slug(strip(x), "[^A-Za-z0-9._-]+", "-", r"\-._", F.lit("value"))


def slug_piece(x: Column | str) -> Column:
    return _slug(strip(x), "[^A-Za-z0-9._-]+", "-", r"\-._", F.lit("blank"))


def slug_id(x: Column | str) -> Column:
    return _slug(F.lower(strip(x)), "[^a-z0-9]+", "_", "_", F.lit("none"))


def slug_run(x: Column | str) -> Column:
    return _slug(strip(x), "[^A-Za-z0-9._-]+", "-", r"\-._", F.lit("unknown"))


def block_file(model: Column | str, temperature: Column | str, version: Column | str) -> Column:
    """File name of a block: slugs and the start of a SHA-1 of its key."""

    def of(t: Column) -> Column:
        key = F.substring(F.sha1(F.concat_ws("|", _c(model), t, _c(version))), 1, 10)
        return F.concat(F.lit("block__model-"), slug_file(model), F.lit("__temp-"), slug_file(t), F.lit("__prompt-"), slug_file(version), F.lit("__"), key, F.lit(".csv"))

    return once(temperature_key(temperature), of)
