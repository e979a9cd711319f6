"""Table schemas and the required-column guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenrank.tiers import N_TIERS

ITEMS = "item_id string, path string, name string, dir string, ext string, length bigint, mtime timestamp"

PREDICTIONS = (
    "image_path string, predicted_quality int, quality_label string, confidence double, "
    "success boolean, error string, all_probabilities array<double>"
)

# flat text form: the array becomes one column per tier; tiers are read as
# double because files with failed rows hold "3.0" instead of "3"
PREDICTIONS_CSV = (
    "image_path string, predicted_quality double, quality_label string, confidence double, "
    "success boolean, error string, "
    + ", ".join(f"prob_quality_{i} double" for i in range(N_TIERS))
)

ANNOTATIONS_CSV = "timestamp string, image_path string, label string, class_name string"

MAPPING_CSV = "path string, dir string"

DUELS = "session_id bigint, seq bigint, winner string, loser string"

RATINGS = "session_id bigint, item string, raw_score double, score double"

VOTE_STATE_JSON = (
    "method string, raw_scores map<string,double>, scores map<string,double>, "
    "comparisons_count bigint, max_comparisons bigint, is_normalized boolean, "
    "comparisons array<struct<timestamp:string,image1:string,image2:string,winner:string,"
    "score1_before:double,score2_before:double,score1_after:double,score2_after:double>>"
)


class MissingColumnsError(ValueError):
    """Raised before any job runs when a table lacks required columns."""

    def __init__(self, missing: list[str], available: list[str]):
        self.missing = missing
        super().__init__(f"missing columns {missing}; the table has {available}")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing, df.columns)
    return df


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
