"""End-to-end chains of the reference's scripts, expressed as one lazy plan each (sections 3.1-3.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.labels import label_name, label_rating
from tonality.functions.text import clean_ascii, normalize_text, words
from tonality.operators import dist, rank
from tonality.operators.lookup import lexicon_labels, score_lexicon
from tonality.operators.split import split_exact, split_stratified
from tonality.session import materialize
from tonality.sources import tables as S


def text_info(reviews: DataFrame) -> DataFrame:
    """Text preprocessing output (text_dataset_info shape plus key and split):
    ``review_id, original_review, comment_clean, sentiment_label, label_numeric, split``."""
    labelled = reviews.select(
        "review_id", F.col("verified_reviews").alias("original_review"),
        normalize_text("verified_reviews").alias("comment_clean"),
        label_rating("rating", "le2").alias("label_numeric"))
    labelled = labelled.withColumn("sentiment_label", label_name("label_numeric"))
    return split_stratified(labelled, "review_id", "label_numeric", fractions=(0.2, 0.8), names=("test", "train"))


def text_preprocess_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: reviews -> clean -> label -> stratified 80/20 split -> rows per (split, class)."""
    info = text_info(S.reviews(spark, sf_dir))
    return (info.groupBy("split", "label_numeric", "sentiment_label")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(F.length("comment_clean")).cast("long").alias("clean_chars"))
            .orderBy("split", "label_numeric"))


def text_analysis_frame(reviews: DataFrame) -> DataFrame:
    """Text analysis inputs: strict clean + the >=4 / =3 / else labelling."""
    return reviews.select("review_id", clean_ascii("verified_reviews").alias("cleaned_text"),
                          label_name(label_rating("rating", "ge4")).alias("sentiment"))


def emoji_analysis(lexicon: DataFrame, n: int = 100, k: int = 10) -> dict[str, DataFrame]:
    """Emoji analysis: score, keep frequent symbols, 10 best and 10 worst."""
    scored = score_lexicon(lexicon, n)
    return {
        "best": rank.top_k(scored, ["sentiment_score", "Occurrences"], k, ascending=False, tie_break=["Emoji"]),
        "worst": rank.top_k(scored, ["sentiment_score", "Occurrences"], k, ascending=[True, False], tie_break=["Emoji"]),
    }


def emoji_info(lexicon: DataFrame, names: DataFrame | None = None, split: bool = True) -> DataFrame:
    """Emoji preprocessing output: ``emoji, emoji_clean, sentiment_label, label_numeric`` and, with
    ``split``, the exact stratified 80/20 split keyed on the symbol."""
    from tonality.operators.lookup import demojize
    info = lexicon_labels(lexicon)
    if names is None:
        info = info.withColumn("emoji_clean", F.col("emoji"))
    else:
        info = demojize(info, "emoji", names, out="emoji_clean")
    if split:
        info = split_stratified(info, "emoji", "label_numeric", fractions=(0.2, 0.8), names=("test", "train"))
    return info


def text_analysis(reviews: DataFrame, tol: float = 1e-4, max_iter: int = 1000):
    """text_ana in full: clean, label (>= 4 positive), exact 80/20 split, fit by L-BFGS, predict both parts.

    Returns the model and ``review_id, label, split, probs, predicted`` of all rows.
    """
    from tonality.operators.text_model import class_probabilities, fit_text_optimum

    d = reviews.select("review_id", words(clean_ascii("verified_reviews"), 2).alias("tokens"), label_rating("rating", "ge4").alias("label"))
    d = materialize(split_exact(d, "review_id", (0.2, 0.8), ("test", "train"), seed=42, rounding="ceil"), "baseline-tokens")
    model = fit_text_optimum(d.where(F.col("split") == "train"), "review_id", tol=tol, max_iter=max_iter)
    return model, class_probabilities(model, d, "review_id").join(d.select("review_id", "label", "split"), "review_id")
