"""What a finding is, and the registry of every code with its severity, layer and kind of repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one schema of findings; location and evidence are JSON text, typed columns stay with each operator's own output.
FINDING = "code string, severity string, layer string, path string, episode_index long, frame_index long, feature_key string, location string, evidence string, message string"

SEVERITIES = ("error", "warning", "info")
LAYERS = ("provenance", "metadata", "schema", "data", "alignment", "media")

# The codes that audits report, each with severity, layer and who can repair it.
RULES = """
LEROBOT_FRAME_COUNT_MISMATCH error alignment delegated
LEROBOT_TASK_COUNT_MISMATCH error alignment delegated
LEROBOT_VIDEO_COUNT_MISMATCH error alignment delegated
LEROBOT_DATA_SHARD_COUNT_MISMATCH error alignment delegated
LEROBOT_EPISODE_INDEX_NON_CONTIGUOUS error alignment delegated
LEROBOT_EPISODE_RANGE_INVALID error alignment delegated
LEROBOT_EPISODE_RANGE_LENGTH_MISMATCH error alignment delegated
LEROBOT_EPISODE_RANGE_GAP error alignment delegated
LEROBOT_EPISODE_RANGE_OVERLAP error alignment delegated
LEROBOT_EPISODE_RANGE_OUT_OF_BOUNDS error alignment delegated
LEROBOT_PARQUET_UNFINALIZED error data delegated
LEROBOT_PARQUET_SCHEMA_UNREADABLE error schema delegated
LEROBOT_PARQUET_ROW_GROUP_UNREADABLE error data delegated
LEROBOT_PARQUET_ROW_INVALID error data delegated
LEROBOT_FEATURE_COLUMN_MISSING error schema delegated
LEROBOT_FEATURE_COLUMN_UNDECLARED warning schema manual
LEROBOT_FEATURE_DTYPE_MISMATCH error schema delegated
LEROBOT_FEATURE_SHAPE_MISMATCH error schema delegated
LEROBOT_FEATURE_NULLABILITY_MISMATCH error schema delegated
LEROBOT_DATA_ROW_COUNT_MISMATCH error data delegated
LEROBOT_EPISODE_ROW_COUNT_MISMATCH error alignment delegated
LEROBOT_FRAME_INDEX_DUPLICATE error alignment delegated
LEROBOT_FRAME_INDEX_NON_CONTIGUOUS error alignment delegated
LEROBOT_GLOBAL_INDEX_DUPLICATE error alignment delegated
LEROBOT_GLOBAL_INDEX_NON_CONTIGUOUS error alignment delegated
LEROBOT_NUMERIC_NON_FINITE error data delegated
LEROBOT_TASK_REFERENCE_INVALID error alignment delegated
LEROBOT_TIMESTAMP_NON_MONOTONIC error alignment delegated
LEROBOT_TIMESTAMP_OFF_GRID error alignment delegated
LEROBOT_VIDEO_COVERAGE_MISSING error media delegated
LEROBOT_VIDEO_RESOLUTION_MISMATCH error media delegated
LEROBOT_VIDEO_FPS_MISMATCH error media delegated
LEROBOT_VIDEO_CHANNELS_MISMATCH error media delegated
LEROBOT_STATS_MISSING warning metadata manual
LEROBOT_STATS_FIELD_MISSING warning metadata manual
LEROBOT_STATS_SHAPE_MISMATCH error alignment delegated
LEROBOT_STATS_COUNT_MISMATCH error alignment delegated
LEROBOT_STATS_NON_FINITE error data delegated
LEROBOT_STATS_VALUE_MISMATCH error alignment delegated
DATASET_NOT_FOUND error provenance manual
DATASET_INVALID_ARGUMENT error provenance manual
DATASET_PATH_OUTSIDE_ROOT error provenance manual
DATASET_SYMLINK_SKIPPED warning provenance manual
DATASET_SYMLINK_BROKEN error provenance manual
HUB_PARTIAL_COVERAGE warning provenance manual
HUB_DOWNLOAD_BUDGET_EXHAUSTED warning provenance manual
HUB_PUBLICATION_METADATA_MISSING warning provenance manual
LEROBOT_INFO_MISSING error metadata delegated
LEROBOT_CODEBASE_VERSION_MISSING error metadata delegated
LEROBOT_CODEBASE_VERSION_INVALID error metadata delegated
LEROBOT_CODEBASE_VERSION_UNTESTED warning metadata delegated
LEROBOT_CODEBASE_VERSION_UNSUPPORTED error metadata delegated
LEROBOT_V21_MIGRATION_RECOMMENDED info provenance manual
LEROBOT_LAYOUT_VERSION_MISMATCH error metadata delegated
LEROBOT_METADATA_INVALID error metadata delegated
LEROBOT_EPISODES_MISSING error metadata delegated
LEROBOT_EPISODES_UNREADABLE error metadata delegated
LEROBOT_TASKS_MISSING error metadata delegated
LEROBOT_TASKS_UNREADABLE error metadata delegated
LEROBOT_TASK_INVALID error metadata delegated
LEROBOT_STATS_INVALID error metadata delegated
LEROBOT_DEPENDENCY_MISSING error metadata manual
LEROBOT_EPISODE_INVALID error metadata delegated
LEROBOT_EPISODE_INDEX_INVALID error data delegated
LEROBOT_EPISODE_LENGTH_INVALID error data delegated
LEROBOT_EPISODE_INDEX_DUPLICATE error data delegated
LEROBOT_EPISODE_COUNT_MISMATCH error alignment delegated
LEROBOT_DATA_PATH_TEMPLATE_INVALID error metadata delegated
LEROBOT_DATA_RELATION_MISSING error alignment delegated
LEROBOT_DATA_RELATION_INVALID error alignment delegated
LEROBOT_DATA_MISSING error data delegated
LEROBOT_DATA_UNREADABLE error data delegated
LEROBOT_VIDEO_MISSING error alignment manual
LEROBOT_VIDEO_RELATION_MISSING error alignment delegated
LEROBOT_VIDEO_RELATION_INVALID error alignment delegated
LEROBOT_VIDEO_PATH_TEMPLATE_INVALID error metadata delegated
LEROBOT_VIDEO_PATH_INVALID error alignment delegated
LEROBOT_VIDEO_SEGMENT_BOUNDS_INVALID error alignment delegated
LEROBOT_VIDEO_SEGMENT_OVERLAP error alignment delegated
LEROBOT_VIDEO_SEGMENT_OUT_OF_RANGE error alignment delegated
LEROBOT_VIDEOS_MISSING error media manual
VIDEO_UNREADABLE error media delegated
VIDEO_INVALID_FPS error media delegated
VIDEO_INVALID_DURATION error media delegated
VIDEO_INVALID_DIMENSIONS error media delegated
VIDEO_PREVIEW_DECODE_FAILED error media delegated
STREAM_INCONSISTENT_RESOLUTION warning media delegated
STREAM_INCONSISTENT_FPS warning media delegated
DUPLICATE_CONTENT warning provenance manual
"""

# Codes of advisory signals and of readiness gates.
ADVISORIES = (
    "ADVISORY_SHORT_EPISODE",
    "ADVISORY_DUPLICATE_EPISODE_CONTENT",
    "ADVISORY_TASK_COVERAGE_IMBALANCE",
    "ADVISORY_CAMERA_COVERAGE_IMBALANCE",
    "ADVISORY_NEAR_ZERO_VARIANCE_DIMENSION",
    "ADVISORY_IDLE_ACTION_SPAN",
    "ADVISORY_ACTION_SATURATION",
)
GATES = (
    "READINESS_FORMAT_INCOMPATIBLE",
    "READINESS_ADAPTER_INCOMPATIBLE",
    "READINESS_DATASET_VERSION_INCOMPATIBLE",
    "READINESS_FEATURE_MISSING",
    "READINESS_FEATURE_DTYPE_MISMATCH",
    "READINESS_FEATURE_SHAPE_MISMATCH",
    "READINESS_ACTION_DIMENSION_MISMATCH",
    "READINESS_NORMALIZATION_MISMATCH",
    "READINESS_DELTA_HORIZON_MISMATCH",
    "READINESS_FEATURE_GROUP_MISSING",
    "READINESS_METADATA_MISSING",
    "READINESS_HUB_REVISION_UNPINNED",
)


def rules() -> list[tuple[str, str, str, str]]:
    """(code, severity, layer, repair) in registry order."""
    return [tuple(line.split()) for line in RULES.split("\n") if line]


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a frame of 89 rows."""
    return spark.createDataFrame(rules(), "code string, severity string, layer string, repair string")


def findings(df: DataFrame, code: str, **columns) -> DataFrame:
    """Rows of `df` as findings of `code`: columns by name as expressions, what is missing null; severity and layer from the registry."""
    known = {c: (s, layer) for c, s, layer, _ in rules()}
    severity, layer = known.get(code, ("warning" if code.startswith("ADVISORY") else "error", "data"))
    given = {"code": F.lit(code), "severity": F.lit(severity), "layer": F.lit(layer)} | columns
    wanted = [x.split() for x in FINDING.split(", ")]
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in wanted])
