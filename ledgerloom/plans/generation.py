"""Generation plans and emotion configurations: nested JSON to rows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coerce import once, slug_id

# The axes of a plan in nesting order, (list key, single key, default).
AXES = (
    ("domains", "domain", "general"), ("splits", "split", ""), ("amount_buckets", "amount_bucket", ""), ("emotions", "emotion", "none"),
    ("risk_orientations", "risk_orientation", "neutral"), ("realization_frames", "realization_frame", "none"), ("outcome_valences", "outcome_valence", "none"),
    ("control_types", "control_type", "none"), ("contrast_roles", "contrast_role", "positive"),
)
#: Parts of a batch id, in order.
BATCH_PARTS = ("plan", "alias", "cell_id", "split", "domain", "emotion", "risk_orientation", "realization_frame", "outcome_valence", "amount_bucket", "control_type", "contrast_role")


#: A plan document; the values of cells stay JSON.
_PLAN = "struct<name: string, default_count_per_cell_per_model: int, models: array<struct<alias: string, model: string>>, cells: array<map<string, string>>>"


def _values(cell: dict[str, Any], many: str, one: str, default: str) -> list[str]:
    got = cell.get(many, str(cell.get(one, default)))
    got = [got] if isinstance(got, str) else got
    if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
        raise ValueError(f"{many} is a text or a list of texts")
    return got


def cells(spark: SparkSession, plan: dict[str, Any]) -> DataFrame:
    """One row per (model, cell) with its axes as arrays. A plan is a small document, so it is read on the driver."""
    if not isinstance(plan.get("models"), list) or not plan["models"] or not isinstance(plan.get("cells"), list) or not plan["cells"]:
        raise ValueError("a plan has models and cells, both non-empty lists")
    default, rows = int(plan.get("default_count_per_cell_per_model", 3)), []
    for m, model in enumerate(plan["models"]):
        for c, cell in enumerate(plan["cells"]):
            axes = [_values(cell, *a) for a in AXES]
            rows.append((str(plan.get("name", "openrouter_prompt_generation")), m, str(model["alias"]), str(model["model"]), c, str(cell.get("cell_id", "")), int(cell.get("count_per_model", default)), *axes))
    schema = "plan string, m int, alias string, model string, c int, cell_id string, count int, " + ", ".join(f"{a[0]} array<string>" for a in AXES)
    return spark.createDataFrame(rows, schema)


def cells_of(plans: DataFrame, content: str = "content") -> DataFrame:
    """``cells`` of many plans, a JSON document in each row; a plan without models or cells raises.

    An axis is a list, a text that stands for a list of one, or missing.
    """
    wrong = F.raise_error(F.concat(F.lit("a plan has models and cells, both non-empty lists: "), F.substring(content, 1, 100)))
    own = plans.select(content, F.from_json(content, _PLAN).alias("p"))
    own = own.select(F.when((F.size("p.models") > 0) & (F.size("p.cells") > 0), F.col("p")).otherwise(wrong.cast(_PLAN)).alias("p"))
    # outer, as no list is empty: from an inner explode Spark derives filters that parse each document again
    own = own.select("p.name", F.coalesce("p.default_count_per_cell_per_model", F.lit(3)).alias("least"), "p.cells", F.posexplode_outer("p.models").alias("m", "model"))
    own = own.select("name", "least", "m", "model", F.posexplode_outer("cells").alias("c", "cell"))
    of = lambda key: F.try_element_at("cell", F.lit(key))  # noqa: E731  lists arrive as JSON texts
    axes = [
        F.when(of(many).isNull(), F.array(F.coalesce(of(one), F.lit(default)))).when(of(many).startswith("["), F.from_json(of(many), "array<string>")).otherwise(F.array(of(many))).alias(many)
        for many, one, default in AXES
    ]
    return own.select(
        F.coalesce("name", F.lit("openrouter_prompt_generation")).alias("plan"), "m", F.col("model.alias").alias("alias"), F.col("model.model").alias("model"), "c",
        F.coalesce(of("cell_id"), F.lit("")).alias("cell_id"), F.coalesce(of("count_per_model").try_cast("int"), "least").alias("count"), *axes,
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``cells`` of a plan file in any store Spark reads."""
    return cells(spark, json.loads(spark.read.text(path, wholetext=True).first()[0]))


def jobs(plan_cells: DataFrame) -> DataFrame:
    """One row per combination of a cell's axes, with its ``place`` in nesting order and ``batch_id``.

    A slug is made once for each value of a cell, before the product; the outer explodes keep Spark from deriving filters that make
    the lists again below.
    """
    axes = [many for many, _, _ in AXES]
    heads = [p for p in BATCH_PARTS if p in plan_cells.columns]
    own = plan_cells.withColumns({many: F.transform(many, lambda x: F.struct(x.alias("value"), _part(x).alias("part"))) for many in axes} | {f"_{p}": _part(F.col(p)) for p in heads})
    for many, one, _ in AXES:
        own = own.select("*", F.posexplode_outer(many).alias(f"p_{one}", f"_{one}")).where(F.col(f"p_{one}").isNotNull()).drop(many)
    parts = [F.col(f"_{p}" if p in heads else f"_{p}.part") for p in BATCH_PARTS]
    values = [F.col(f"_{one}.value").alias(one) for _, one, _ in AXES]
    place = F.struct("m", "c", *(f"p_{one}" for _, one, _ in AXES)).alias("place")
    return own.select(*[c for c in plan_cells.columns if c not in {"m", "c", *axes}], *values, F.concat_ws("__", *parts).alias("batch_id"), place)


def _part(x: Column) -> Column:
    """A value as a part of a batch id; null, which leaves the part out, if it is empty. Most values are slugs already, which one match tells."""
    return once(x, lambda v: F.when(v.rlike(r"^[a-z0-9]+(?:_[a-z0-9]+)*\z"), v).when(v != "", slug_id(v)))


def first_jobs(plan_cells: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of ``jobs`` of one plan, by place, without the product of the axes.

    Sizes of cells give each cell's share of the count; a job's number in its cell gives its value on every axis, the last axis running fastest.
    """
    size = F.lit(1).cast("long")
    for many, _, _ in AXES:
        size = size * F.size(many)
    before = Window.orderBy("m", "c").rowsBetween(Window.unboundedPreceding, -1)  # a row for each model and cell of a plan
    own = plan_cells.withColumn("_size", size).withColumn("_share", F.least(F.col("_size"), F.lit(count) - F.coalesce(F.sum("_size").over(before), F.lit(0))))
    own = own.where("_share > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_share") - 1)))
    for many, one, _ in reversed(AXES):
        at = F.pmod("_k", F.size(many)).cast("int")
        own = own.withColumns({f"p_{one}": at, one: F.get(many, at)}).withColumn("_k", F.floor(F.col("_k") / F.size(many)))
    places = ["m", "c", *(f"p_{one}" for _, one, _ in AXES)]
    parts = [F.when(F.col(p) != "", slug_id(p)) for p in BATCH_PARTS]
    own = own.withColumns({"batch_id": F.concat_ws("__", *parts), "place": F.struct(*places)})
    return own.drop(*places, "_size", "_share", "_k", *(many for many, _, _ in AXES))


def requests(job_rows: DataFrame, most: int) -> DataFrame:
    """Jobs cut into requests of at most ``most`` prompts; several get the suffixes part_001, part_002 ..."""
    if most <= 0:
        return job_rows.withColumns({"part": F.lit(1), "request_count": F.col("count")})
    own = job_rows.withColumn("part", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("count") / most), F.lit(1)).cast("int"))))
    many = F.col("count") > most
    return own.withColumns({
        "request_count": F.least(F.lit(most), F.col("count") - (F.col("part") - 1) * most),
        "batch_id": F.when(many, F.concat("batch_id", F.lit("__part_"), F.lpad(F.col("part").cast("string"), 3, "0"))).otherwise(F.col("batch_id")),
    })


def estimate(job_rows: DataFrame, most: int, rows_per_unit: Column | int = 1) -> DataFrame:
    """One row: jobs, prompt rows, requests."""
    units = rows_per_unit if isinstance(rows_per_unit, Column) else F.lit(rows_per_unit)
    requests_of = F.ceil(F.col("count") / most) if most > 0 else F.lit(1)
    return job_rows.agg(F.count("*").alias("jobs"), F.sum(F.col("count") * units).alias("rows"), F.sum(requests_of).alias("requests"))


def remaining(job_rows: DataFrame, existing: DataFrame, rows_per_unit: int = 1) -> DataFrame:
    """Jobs with ``done`` and ``remaining`` units, from existing prompt ids that begin with the batch id and two underscores.

    Every such prefix of an id is a key, so this is an equi-join and no scan of all ids for each job.
    """
    ids = existing.select("prompt_id").where("prompt_id is not null").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split("prompt_id", "__"))), lambda i: F.array_join(F.slice(F.split("prompt_id", "__"), 1, i), "__"))
    prefixes = ids.select(F.explode(cut).alias("batch_id"), "prompt_id").where("prompt_id <> batch_id").groupBy("batch_id").agg(F.count("*").alias("_n"))
    own = job_rows.join(prefixes, "batch_id", "left")
    done = F.floor(F.coalesce("_n", F.lit(0)) / rows_per_unit)
    return own.withColumns({"done": done, "remaining": F.greatest(F.lit(0), F.col("count") - done)}).drop("_n")


def one_per_cell(plan: dict[str, Any], count: int = 1) -> dict[str, Any]:
    """The plan with the first value of every axis only: one job for each cell and model."""
    out = []
    for cell in plan["cells"]:
        own = {k: v for k, v in cell.items() if k not in {a[0] for a in AXES}}
        out.append(own | {one: cell[many][0] for many, one, _ in AXES if cell.get(many)} | {"count_per_model": count})
    return plan | {"cells": out}


def emotion_prompts(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """(prompt_id, prompt_text, emotion, cluster, contrast_role, variant_id, effect): two rows per variant of each emotion."""
    template = config.get("template")
    if not isinstance(template, str) or "{scenario}" not in template or not config.get("emotions"):
        raise ValueError("a template with {scenario} and a list of emotions are needed")
    rows = []
    for e in config["emotions"]:
        variants = e.get("variants", [e])
        if not isinstance(variants, list) or not variants:
            raise ValueError("variants is a non-empty list")
        for i, v in enumerate(variants, 1):
            name = str(v.get("variant_id") or f"{i:02d}").strip() if "variants" in e else None
            texts = [(r, v.get(f"{r}_prompt")) for r in ("positive", "control")]
            fields = [e.get(k) for k in ("emotion", "cluster", "expected_behavior_effect")]
            if not all(isinstance(x, str) and x.strip() for x in [*fields, *(t for _, t in texts)]):
                raise ValueError("an emotion lacks a text")
            emotion, cluster, effect = (x.strip() for x in fields)
            for role, t in texts:
                rows.append(("__".join(x for x in (emotion, name, role) if x), template.replace("{scenario}", t.strip()), emotion, cluster, role, name, effect))
    return spark.createDataFrame(rows, "prompt_id string, prompt_text string, emotion string, cluster string, contrast_role string, variant_id string, effect string")


def decode_prompts(responses: DataFrame, content: str = "content") -> DataFrame:
    """Rows of the prompts in JSON answers ``{"prompts": [{"variant_id", "prompt_text"}]}``; missing ids are variant_001, ..."""
    own = responses.withColumn("_j", F.from_json(content, "prompts array<struct<variant_id:string,prompt_text:string>>"))
    own = own.select(*responses.columns, F.posexplode("_j.prompts").alias("_i", "_p"))
    name = F.coalesce(F.nullif(F.trim("_p.variant_id"), F.lit("")), F.format_string("variant_%03d", F.col("_i") + 1))
    return own.select(*responses.columns, name.alias("variant_id"), F.col("_p.prompt_text").alias("prompt_text"))


#: (list, id, id's default, texts) of the two forms of answers.
FORMS = {
    "prompts": ("variant_id", "variant_%03d", ("prompt_text",)),
    "pairs": ("pair_id", "pair_%03d", ("paper_open_prompt_text", "realized_closed_prompt_text")),
}


def answer_content(response: Column | str) -> Column:
    """The text of a chat response's first choice, or its parts' texts put together; null if there is none."""
    v = F.try_parse_json(response)
    content = "$.choices[0].message.content"
    parts = F.transform(F.try_variant_get(v, content, "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    listed = F.schema_of_variant(F.try_variant_get(v, content, "variant")).startswith("ARRAY")
    return F.when(listed, F.array_join(parts, "")).otherwise(F.try_variant_get(v, content, "string"))


def decode_answers(responses: DataFrame, content: str = "content", form: str = "prompts") -> DataFrame:
    """Rows of the prompts or pairs in free answers: the responses' columns, ``at`` (from 1), the id, the texts, notes and ``error``.

    JSON may stand in a fenced block. An answer that is no JSON, has no such list, or an item that is no object or lacks a text, is one
    row with its reason in ``error`` and nulls. Missing or blank ids are numbered.
    """
    key, default, texts = FORMS[form]
    fenced = F.regexp_extract(content, r"(?s)```(?:[A-Za-z]*)\s*\n(.*?)```", 1)
    own = responses.withColumn("_v", F.try_parse_json(F.when(fenced != "", fenced).otherwise(F.col(content))))
    own = own.withColumn("_items", F.try_variant_get("_v", f"$.{form}", "array<variant>"))
    field = lambda p, name: F.trim(F.coalesce(F.try_variant_get(p, f"$.{name}", "string"), F.lit("")))
    item = lambda p: F.struct(F.schema_of_variant(p).startswith("OBJECT").alias("object"), *[field(p, name).alias(name) for name in (key, *texts, "notes")])
    own = own.withColumn("_items", F.transform("_items", item))
    lacking = F.lit(False)
    for t in texts:
        lacking = lacking | F.array_contains(F.col("_items")[t], "")
    error = F.when(F.col(content).isNull(), "no_content").when(F.col("_v").isNull(), "no_json").when(F.col("_items").isNull(), "no_list")
    error = error.when(F.array_contains(F.col("_items")["object"], False), "no_object").when(lacking, "empty_text")
    own = own.withColumn("error", error)
    shown = F.when(F.col("error").isNull(), F.col("_items")).otherwise(F.array(F.lit(None).cast(own.schema["_items"].dataType.elementType)))
    rows = own.select(*responses.columns, "error", F.posexplode(shown).alias("_i", "_p"))
    number = F.when(F.col("error").isNull(), F.col("_i") + 1)
    name = F.when(F.col("error").isNull(), F.coalesce(F.nullif(F.col(f"_p.{key}"), F.lit("")), F.format_string(default, F.col("_i") + 1)))
    return rows.select(*responses.columns, number.alias("at"), name.alias(key), *[F.col(f"_p.{t}").alias(t) for t in (*texts, "notes")], "error")
