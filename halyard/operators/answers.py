"""Answers of a model as tables. An answer is text that should hold a JSON object; whatever of it can't be used is left out.

Fields may be missing or of any type. VARIANT keeps an answer as it is until a field is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.config import DEFAULT, Config
from halyard.functions.columns import json_object

MAP = "map<string,variant>"


def parsed(answer: Column) -> Column:
    """The outermost object of an answer with fences or talk around it, as VARIANT; null if there is none, or if more follows it.

    The parser stops at the end of a value, so the text is put into a list, which must hold one value.
    """
    items = F.try_parse_json(F.concat(F.lit("["), json_object(answer), F.lit("]"))).try_cast("array<variant>")
    v = F.when(F.size(items) == 1, F.element_at(items, 1))
    return F.when(is_object(v), v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def field(v: Column, name: str) -> Column:
    """A field as text, whatever it is: strings as they are, booleans and numbers as JSON writes them, null and nothing as null."""
    return F.try_variant_get(v, f"$.{name}", "string")


def figure(v: Column, name: str) -> Column:
    """A field that should be a number, as text; true and false count as 1 and 0. See columns.number for the rest."""
    text = field(v, name)
    boolean = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN"
    return F.when(boolean, F.when(text == "true", "1").otherwise("0")).otherwise(text)


def _filled(v: Column, name: str) -> Column:
    """Whether a field holds something: not null, false, 0, '', [] or {}."""
    text = F.try_variant_get(v, f"$.{name}", "string")
    return F.coalesce(~text.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def card_rows(answers: DataFrame) -> DataFrame:
    """Cards (see evidence) of answers to single documents: unit_id, doc_id, day, answer.

    doc_id and day are the table's own, whatever the answer says. An answer without an object per_asset gives no card (see
    refused). A card gives a row for each asset of which it says something, or one without an asset. Further columns:
    fact_list (first three), tone, summary.
    """
    v = F.col("v")
    rows = answers.withColumn("v", parsed(F.col("answer"))).withColumn("assets", F.try_variant_get("v", "$.per_asset", MAP)).where("assets is not null")
    said = F.filter(F.map_entries("assets"), lambda e: is_object(e["value"]))
    event = F.try_variant_get(v, "$.event_in_window", "variant")
    words = F.array_join(F.array_compact(F.array(*[F.try_variant_get(event, f"$.{c}", "string") for c in ("what", "description", "name", "why")])), " ")
    facts = F.try_variant_get(v, "$.established_facts", "array<string>")
    rows = rows.select(
        "unit_id", "doc_id", "day", figure(v, "relevance").alias("relevance"), _filled(v, "established_facts").alias("facts"), F.coalesce(F.slice(facts, 1, 3), F.array().cast("array<string>")).alias("fact_list"),
        F.try_variant_get(event, "$.exists", "string").alias("event_exists"), F.coalesce(F.try_variant_get(event, "$.type", "string"), F.lit("")).alias("event_type"),
        F.when(words != "", words).otherwise(F.coalesce(field(v, "event_in_window"), F.lit(""))).alias("event_words"),
        F.coalesce(field(v, "inferred_tone"), F.lit("")).alias("tone"), F.coalesce(field(v, "summary"), F.lit("")).alias("summary"), F.explode_outer(said).alias("e"),
    )
    a = F.col("e.value")
    return rows.select(
        "unit_id", "doc_id", "day", F.col("e.key").alias("asset"), figure(a, "direction").alias("direction"), figure(a, "strength").alias("strength"), F.coalesce(field(a, "uncertainty"), F.lit("")).alias("uncertainty"),
        "relevance", "facts", "fact_list", "event_exists", "event_type", "event_words", "tone", "summary",
    )


def refused(answers: DataFrame) -> DataFrame:
    """unit_id, doc_id, problem of answers that give no card."""
    v = parsed(F.col("answer"))
    problem = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "no answer").when(v.isNull(), "no JSON object").when(F.try_variant_get(v, "$.per_asset", MAP).isNull(), "per_asset is not an object")
    return answers.select("unit_id", "doc_id", problem.alias("problem")).where("problem is not null")


def scenario_rows(answers: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw scenarios, their evidence, one row for each unit with tail_df, stress_prob, disagreement) of answers: unit_id, answer.

    The first max_scenarios entries of the list `scenarios` count; those that are no objects are passed over, as is evidence
    that is no text. Units whose answer has no such list have no row.
    """
    v = F.col("v")
    rows = answers.withColumn("v", parsed(F.col("answer"))).withColumn("s", F.try_variant_get("v", "$.scenarios", "array<variant>")).where(F.size("s") > 0)
    each = rows.select("unit_id", F.posexplode(F.slice("s", 1, config.max_scenarios)).alias("scenario", "x")).where(is_object(F.col("x")))
    x = F.col("x")
    drift, width = (F.coalesce(F.try_variant_get(x, f"$.{c}", MAP), F.create_map().cast(MAP)) for c in ("drift", "vol_mult"))
    named = each.select("unit_id", "scenario", field(x, "name").alias("name"), figure(x, "weight").alias("weight"), drift.alias("d"), width.alias("w"), x)
    named = named.withColumn("asset", F.explode_outer(F.array_union(F.map_keys("d"), F.map_keys("w"))))

    def of(m: str) -> Column:
        one = F.try_element_at(F.col(m), F.col("asset"))
        text = F.try_variant_get(one, "$", "string")
        return F.when(F.schema_of_variant(one) == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).otherwise(text)

    raw = named.select("unit_id", "scenario", "name", "asset", "weight", of("d").alias("drift"), of("w").alias("vol_mult"))
    proof = each.select("unit_id", "scenario", F.explode(F.try_variant_get(x, "$.evidence", "array<variant>")).alias("e"))
    proof = proof.where(F.schema_of_variant("e") == "STRING").select("unit_id", "scenario", F.try_variant_get("e", "$", "string").alias("doc_id"))
    extra = rows.select("unit_id", figure(v, "tail_df").alias("tail_df"), figure(v, "stress_prob").alias("stress_prob"), F.substring(field(v, "disagreement"), 1, 240).alias("disagreement"))
    return raw, proof, extra
