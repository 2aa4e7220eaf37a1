"""Language profiles from labelled text, and the classifier that uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions.language import needs_detector, source_of, text_profile
from unitflow.functions.ngrams import char_grams, longest_grams
from unitflow.operators.detector import PROFILE_BYTES, detected_label, load_profile, profile_bytes
from unitflow.options import ENGLISH
from unitflow.session import materialise

MICRO = 1_000_000  # log-probabilities are whole millionths: sums do not depend on their order


def gram_counts(docs: DataFrame, labels: Sequence[str], label: str = "lang") -> DataFrame:
    """(gram, n_<label> ...): how often each gram occurs under each label.

    Only the longest gram at each position is made and counted. A shorter gram occurs wherever a
    longer one begins with it, so its count is a sum over the few distinct longer ones.
    """
    longest = docs.select(
        F.col(label).alias("_l"), F.explode(longest_grams(F.col("text"))).alias("_g")
    )
    counted = longest.groupBy("_g").agg(
        *[F.count_if(F.col("_l") == name).alias(f"n_{name}") for name in labels]
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("_g")), lambda k: F.substring("_g", F.lit(1), k)
    )
    return (
        counted.withColumn("gram", F.explode(prefixes))
        .groupBy("gram")
        .agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in labels])
    )


def train_profiles(docs: DataFrame, labels: Sequence[str], label: str = "lang") -> DataFrame:
    """(gram, <label> ...): smoothed log-probability of each gram under each label.

    Counts are combined map-side and written once; the driver sees one row of totals.
    """
    counts = materialise(gram_counts(docs, labels, label), "profiles")
    totals = counts.agg(
        F.count("*").alias("v"),
        *[F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"n_{x}") for x in labels],
    ).first()
    scores = [
        F.round(F.ln((F.col(f"n_{x}") + 1) / F.lit(float(totals[f"n_{x}"] + totals["v"]))) * MICRO)
        .cast("bigint")
        .alias(x)
        for x in labels
    ]
    return counts.select("gram", *scores)


def long_profiles(profiles: DataFrame) -> DataFrame:
    """(lang, gram, logp) form of a trained profile."""
    labels = [c for c in profiles.columns if c != "gram"]
    return profiles.unpivot(["gram"], labels, "lang", "logp").select("lang", "gram", "logp")


def best_label(scores: dict[str, Column]) -> Column:
    """Label with the highest score; of equals, the first by name. Null without scores."""
    names = sorted(scores)
    top = F.greatest(*[scores[n] for n in names]) if len(names) > 1 else scores[names[0]]
    out = F.when(scores[names[0]] == top, names[0])
    for name in names[1:]:
        out = out.when(scores[name] == top, name)
    return out


def classify(
    units: DataFrame,
    profiles: DataFrame,
    keys: Sequence[str] = ("doc_id", "unit_idx"),
    max_bytes: int = PROFILE_BYTES,
) -> DataFrame:
    """(keys, label): best label of each unit that has at least one known gram.

    A profile of up to ``max_bytes`` (``detector.profile_bytes``) goes along with the tasks, and a unit is labelled in its
    row. A larger one is joined by (gram, salt), for single letters are hot keys, with a salt for every core.
    """
    labels = [c for c in profiles.columns if c != "gram"]
    if profile_bytes(profiles) <= max_bytes:
        label = detected_label(F.coalesce(F.col("text"), F.lit("")), load_profile(profiles, max_bytes))
        return units.select(*keys, label.alias("label")).filter(F.col("label").isNotNull())
    salts = units.sparkSession.sparkContext.defaultParallelism
    grams = units.select(*keys, F.explode(char_grams(F.col("text"))).alias("gram"))
    salted = profiles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = grams.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).join(
        salted, ["gram", "_salt"]
    )
    sums = scored.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in labels])
    return sums.select(*keys, best_label({x: F.col(x) for x in labels}).alias("label"))


def detect_with_profiles(
    units: DataFrame,
    profiles: DataFrame,
    default: str = ENGLISH,
    keys: Sequence[str] = ("doc_id", "unit_idx"),
    max_bytes: int = PROFILE_BYTES,
) -> DataFrame:
    """Add ``detected`` and ``src_lang``; only texts that a label can decide are classified.

    With a profile of up to ``max_bytes`` nothing is joined; ``keys`` name a unit where a larger one is.
    """
    profiled = units.withColumn("_profile", text_profile(F.col("text")))
    if profile_bytes(profiles) <= max_bytes:
        asked = F.when(needs_detector(F.col("_profile")), F.col("text"))
        told = profiled.withColumn("detected", detected_label(asked, load_profile(profiles, max_bytes)))
    else:
        open_units = profiled.filter(needs_detector(F.col("_profile"))).select(*keys, "text")
        labels = classify(open_units, profiles, keys, max_bytes)
        told = profiled.join(labels.withColumnRenamed("label", "detected"), list(keys), "left")
    source = source_of(F.col("_profile"), default, F.col("detected"))
    return told.withColumn("src_lang", source).drop("_profile")
