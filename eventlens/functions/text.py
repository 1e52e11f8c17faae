"""Per-message text features, all plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions.regex import PY_SPACE, python_match

FEATURES = [
    "message_length", "word_count", "avg_word_length", "is_conventional", "has_ai_keywords",
    "line_count", "has_issue_ref", "starts_with_verb", "capitalized", "ends_with_period",
]


def _flag(cond: Column) -> Column:
    return cond.cast("int")


def feature_columns(msg: str) -> dict[str, Column]:
    m = F.coalesce(F.col(msg), F.lit(""))
    # words = runs of non-space; counting them avoids building the word array
    words = F.regexp_count(m, F.lit(r"(?U)[^\s\x1c-\x1f]+"))
    phrases = r"\b(" + "|".join(config.INDICATOR_PHRASES) + r")\b"
    verbs = r"^(" + "|".join(config.LEADING_VERBS) + r")\b"
    return {
        "message_length": F.char_length(m),
        "word_count": words,
        "avg_word_length": F.char_length(m) / F.greatest(words, F.lit(1)),
        "is_conventional": _flag(python_match(m, config.CONVENTIONAL, ignore_case=True)),
        "has_ai_keywords": _flag(python_match(m, phrases, ignore_case=True)),
        "line_count": F.regexp_count(m, F.lit("\n")) + 1,
        "has_issue_ref": _flag(python_match(m, r"#\d+")),
        "starts_with_verb": _flag(python_match(m, verbs, ignore_case=True)),
        "capitalized": _flag(python_match(m, "^[A-Z]")),
        "ends_with_period": _flag(python_match(m, r"\." + PY_SPACE + r"*\z")),
    }


def text_features(df: DataFrame, msg: str) -> DataFrame:
    """Adds the ten features; a null message counts as the empty string."""
    return df.select("*", *[c.alias(name) for name, c in feature_columns(msg).items()])


def unpivot_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., feature, value: ten narrow rows per message."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")
