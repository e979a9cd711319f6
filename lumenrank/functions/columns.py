"""Scalar functions, Column in and Column out, no Python evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELO_K = 32.0


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the maximum for stability."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    # the one-element transform binds the weights, so they are computed once
    return F.element_at(
        F.transform(
            F.array(weights),
            lambda w: F.transform(w, lambda x: x / _sum(w)),
        ),
        1,
    )


def argmax(arr: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def grades(arr: Column) -> Column:
    return F.sequence(F.lit(1), F.size(arr))


def expected_score(probs: Column) -> Column:
    """Mean grade of a rating distribution over grades 1..n."""
    return _sum(F.zip_with(probs, grades(probs), lambda p, i: p * i))


def score_std(probs: Column) -> Column:
    """Standard deviation of the grade under a rating distribution."""
    return F.element_at(
        F.transform(
            F.array(expected_score(probs)),
            lambda mean: F.sqrt(
                _sum(F.zip_with(probs, grades(probs), lambda p, i: (i - mean) * (i - mean) * p))
            ),
        ),
        1,
    )


def assessment(mean_score: Column) -> Column:
    return (
        F.when(mean_score > 6.5, F.lit("High"))
        .when(mean_score > 4.5, F.lit("Average"))
        .otherwise(F.lit("Low"))
    )


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return F.element_at(
        F.transform(
            F.array(F.greatest(norm(a), F.lit(1e-12))),
            lambda n: F.transform(a, lambda x: x.cast("double") / n),
        ),
        1,
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def median_bits(arr: Column) -> Column:
    """Bit i is set when value i exceeds the median of the (at most 64) values."""
    n = F.size(arr)
    ordered = F.array_sort(arr)
    upper = F.get(ordered, F.floor(n / 2).cast("int")).cast("double")
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int")).cast("double")
    return F.element_at(
        F.transform(
            F.array((upper + lower) / 2),
            lambda median: F.aggregate(
                F.transform(
                    arr,
                    lambda x, i: F.when(
                        x.cast("double") > median,
                        F.call_function("shiftleft", F.lit(1).cast("bigint"), i),
                    ).otherwise(F.lit(0).cast("bigint")),
                ),
                F.lit(0).cast("bigint"),
                lambda acc, b: acc.bitwiseOR(b),
            ),
        ),
        1,
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """Suffix without the dot; hidden files such as ``.profile`` have none."""
    return F.regexp_extract(name, r"[^/]\.([^./]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def elo_expected(rating: Column, opponent: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (opponent - rating) / 400.0))


def normalise_exts(csv_list: Column) -> Column:
    """``" JPG, .png"`` -> ``[".jpg", ".png"]``."""
    return F.transform(
        F.split(csv_list, ","),
        lambda e: F.concat(F.lit("."), F.regexp_replace(F.lower(F.trim(e)), r"^\.", "")),
    )


def clip_round_score(score: Column) -> Column:
    """Two decimals (half even), limited to 0..5."""
    return F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.bround(score, 2)))


def score_category(score: Column) -> Column:
    return F.concat(F.lit("Qualité "), F.bround(score, 0).cast("int").cast("string"))


def hash_bits(key: Column, salt: str, word: int = 0) -> Column:
    """32 reproducible bits of a key as a non-negative bigint."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def event_time() -> Column:
    return F.current_timestamp()
