"""Expressions over file names, labels and number formats of result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature file -> encoder name, and feature file -> display name.
ENCODERS = {
    "transformer_all_minilm_l6_v2": "sentence-transformers/all-MiniLM-L6-v2",
    "transformer_all_mpnet_base_v2": "sentence-transformers/all-mpnet-base-v2",
    "transformer_gtr_t5_base": "sentence-transformers/gtr-t5-base",
    "transformer_sentence_t5_base": "sentence-transformers/sentence-t5-base",
}
DISPLAY_NAMES = {
    "transformer_all_minilm_l6_v2": "All MiniLM L6 v2",
    "transformer_all_mpnet_base_v2": "All MPNet base v2",
    "transformer_gtr_t5_base": "GTR T5 base",
    "transformer_sentence_t5_base": "Sentence T5 base",
}
WORD_VECTOR_PREFIX = "word_embeddings"
WORD_VECTOR_MODEL = "glove-twitter-"


def base_name(path: Column) -> Column:
    """Last part of a path without ``.csv``."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.csv$", "")


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, value in table.items():
        result = result.when(key == name, F.lit(value))
    return result


def feature_file_name(dims: Column, aggregation: Column) -> Column:
    return F.concat(
        F.lit(f"{WORD_VECTOR_PREFIX}_"), dims.cast("string"), F.lit("_"), aggregation, F.lit(".csv")
    )


def embedding_config(path: Column) -> Column:
    """Struct ``(type, model, aggregation)`` of a feature file."""
    base = base_name(path)
    parts = F.split(base, "_")
    encoder = _lookup(base, ENCODERS)
    is_encoder = encoder.isNotNull()
    return F.struct(
        F.when(is_encoder, "sentence_transformer").otherwise("glove").alias("type"),
        F.when(is_encoder, encoder)
        .otherwise(F.concat(F.lit(WORD_VECTOR_MODEL), F.get(parts, F.lit(2))))
        .alias("model"),
        F.when(~is_encoder, F.get(parts, F.lit(3))).alias("aggregation"),
    )


def bundle_name(config: Column, model: Column) -> Column:
    """Name of a saved classifier: encoder, aggregation if any, model."""
    encoder = F.lower(F.translate(F.substring_index(config["model"], "/", -1), "-", "_"))
    return F.concat_ws(
        "_", encoder, config["aggregation"], F.lower(F.translate(model, " ", "_"))
    )


def feature_name(path: Column) -> Column:
    """Display name of a feature file, null if it is unknown."""
    base = base_name(path)
    parts = F.split(base, "_")
    return F.when(
        base.startswith(WORD_VECTOR_PREFIX),
        F.concat(F.get(parts, F.lit(2)), F.lit("-D ("), F.get(parts, F.lit(3)), F.lit(")")),
    ).otherwise(_lookup(base, DISPLAY_NAMES))


def display_dims(name: Column) -> Column:
    return F.split_part(name, F.lit("-"), F.lit(1)).cast("int")


def display_method(name: Column) -> Column:
    return F.regexp_extract(name, r"\((\w+)\)", 1)


def document_number(name: Column) -> Column:
    """The integer inside a document name such as ``post_12``."""
    return F.regexp_extract(name, r"(\d+)", 1).cast("bigint")


def parse_percent(text: Column) -> Column:
    return F.rtrim(text, F.lit("%")).cast("double")


def format_percent(value: Column, digits: int = 2) -> Column:
    """A percentage as text, rounded half up."""
    return F.format_string(f"%.{digits}f%%", value)


def parse_layer_sizes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def null_to_blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def format_prediction(prediction: Column, names: Mapping[int, str]) -> Column:
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, name in names.items():
        result = result.when(prediction == label, F.lit(f"{name} ({label})"))
    return result
