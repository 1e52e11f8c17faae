"""Text-feature queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import text as X
from eventlens.plans.distribution import r6, rounded
from eventlens.plans.registry import query
from eventlens.plans.sqlbase import lit
from eventlens.sources.adapters import table

# characters that count as white space in str.split(), as a class body
_SP = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _alt(words):
    return "(" + "|".join(words) + ")"


_WORDS = f"len(regexp_extract_all(m, {lit('[^' + _SP + ']+')}))"
FEATURE_SQL = {
    "message_length": "length(m)",
    "word_count": _WORDS,
    "avg_word_length": f"length(m) / greatest({_WORDS}, 1)::DOUBLE",
    "is_conventional": f"regexp_matches(m, {lit('(?i)' + config.CONVENTIONAL)})::INTEGER",
    "has_ai_keywords": f"regexp_matches(m, {lit('(?i)' + _EDGE_L + _alt(config.INDICATOR_PHRASES) + _EDGE_R)})::INTEGER",
    "line_count": "length(m) - length(replace(m, chr(10), '')) + 1",
    "has_issue_ref": f"regexp_matches(m, {lit(r'#[[:digit:]]+')})::INTEGER",
    "starts_with_verb": f"regexp_matches(m, {lit('(?i)^' + _alt(config.LEADING_VERBS) + _EDGE_R)})::INTEGER",
    "capitalized": f"regexp_matches(m, {lit('^[A-Z]')})::INTEGER",
    "ends_with_period": f"regexp_matches(m, {lit('[.][' + _SP + ']*' + chr(92) + 'z')})::INTEGER",
}
INT_FEATURES = [f for f in X.FEATURES if f != "avg_word_length"]

DOC_FEATURES = "feat AS (SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items()) + \
    " FROM (SELECT doc_id, coalesce(text, '') AS m FROM documents))"


def document_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return X.text_features(docs, "text").drop("text")


@query("text_features", "TX1", "TX2", "TX3", "TX4", "TX5", "TX6", "TX7", "TX8", "TX9", "TX10", "SRC4", sql=f"""WITH {DOC_FEATURES}
SELECT doc_id, {', '.join(f'CAST({f} AS INTEGER) AS {f}' for f in INT_FEATURES)}, {r6('avg_word_length', 'avg_word_length')} FROM feat""")
def text_features(spark, d):
    return rounded(document_features(spark, d), "avg_word_length")


@query("conversation_features", "TX1", "TX2", "TX4", "TX5", "TX8", sql=f"""
WITH feat AS (SELECT conv_id, turn, role, {', '.join(f'{e} AS {n}' for n, e in FEATURE_SQL.items())}
              FROM (SELECT conv_id, turn, role, coalesce(text, '') AS m FROM conversations))
SELECT role, count(*) AS n, {', '.join(f'sum({f})::BIGINT AS {f}' for f in INT_FEATURES)} FROM feat GROUP BY 1""")
def conversation_features(spark, d):
    rows = X.text_features(table(spark, d, "conversations"), "text")
    return rows.groupBy("role").agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in INT_FEATURES])
