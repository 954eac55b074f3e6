"""Fixed values of the instrument and their lookups as Column expressions.

Every lookup here is a literal map or ``isin`` list inside the plan, so capping,
permission and requirement tests never cost a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: must equal the published instrument for right results -------------
GROUPS = {
    1: "Corpus — what the model was made from",
    2: "Procedure — how the artifact was produced",
    3: "Artifact — the thing shipped",
    4: "Verification — has anyone actually checked",
    5: "Post-training — where behaviour is shaped, and visibility is lowest",
}

# (axis, group, name, may be N/A)
AXES = [
    (1, 1, "corpus enumerated", False),
    (2, 1, "corpus content-addressed", False),
    (3, 1, "corpus committed BEFORE", False),
    (4, 1, "corpus obtainable", False),
    (5, 1, "membership decidable", False),
    (6, 2, "training code released", False),
    (7, 2, "hyperparameters fully specified", False),
    (8, 2, "seeds published", False),
    (9, 2, "determinism settings specified", False),
    (10, 2, "environment pinned", False),
    (11, 2, "data order reproducible", False),
    (12, 3, "weights released", True),
    (13, 3, "weights content-addressed", True),
    (14, 3, "weights signed", True),
    (15, 3, "weights timestamped", True),
    (16, 4, "bit-identical reproduction reported", False),
    (17, 4, "approximate reproduction reported", False),
    (18, 4, "eval harness released and versioned", False),
    (19, 4, "eval/train disjointness checkable", False),
    (20, 5, "fine-tuning data disclosed", True),
    (21, 5, "preference or reward data disclosed", True),
    (22, 5, "safety-training procedure disclosed", True),
]

LEVELS = {2: "VERIFIED", 1: "ASSERTED", 0: "ABSENT"}
AXIS_MAX = {5: 1, 7: 1, 16: 1, 17: 1, 19: 1}
STRATUM_MAX = {"api-only": {12: 0, 13: 1, 14: 1, 15: 1}}
DETERMINED = [(12, "api-only")]

METHODS = [
    "hf_probe.weight_object", "hf_probe.corpus_item_digests", "hf_probe.all_shard_digests",
    "http_range", "http_status", "api_field", "grep_retrieved", "count_in_retrieved",
    "hash_compare", "reproduction_search", "hf_probe.release_artifacts", "repo_tree_probe",
    "hf_probe.signed_commit",
]
# registered, but nothing executes them: never enough for a positive
METHODS_WITHOUT_EXECUTOR = ["http_status", "api_field", "hash_compare"]
THIRD_PARTY_METHODS = ["reproduction_search"]
REPLAYABLE_METHODS = [
    "grep_retrieved", "count_in_retrieved", "http_range", "hf_probe.weight_object",
    "hf_probe.all_shard_digests",
]
PERMITTED_AXES = {
    "grep_retrieved": [a for a in range(1, 23) if a not in (4, 12)],
    "count_in_retrieved": [a for a in range(1, 23) if a not in (4, 12)],
    "http_range": [4, 12],
    "hf_probe.weight_object": [12, 13],
    "hf_probe.all_shard_digests": [12, 13],
    "http_status": [4, 12, 18],
    "api_field": [12, 18],
    "hash_compare": [2, 13, 14, 15],
    "hf_probe.corpus_item_digests": [2],
    "hf_probe.signed_commit": [14],
    "repo_tree_probe": [6],
    "hf_probe.release_artifacts": [3, 14, 15],
    "reproduction_search": [16, 17],
}
REQUIRED_METHOD = {
    6: "repo_tree_probe",
    12: "hf_probe.weight_object",
    13: "hf_probe.all_shard_digests",
}
REQUIRED_FIELDS = {
    "grep_retrieved": ["expect"],
    "count_in_retrieved": ["expect", "expect_count"],
    "hf_probe.weight_object": ["expect_range_bytes", "expect_file", "expect_evidence_sha256"],
    "hf_probe.all_shard_digests": ["expect_shards", "expect_evidence_sha256"],
    "hf_probe.corpus_item_digests": ["expect_files", "expect_repo", "expect_evidence_sha256"],
    "hf_probe.signed_commit": ["expect_revision", "expect_evidence_sha256"],
    "repo_tree_probe": ["expect_repo", "expect_commit", "expect_paths", "expect_evidence_sha256"],
    "hf_probe.release_artifacts": [
        "expect_repo", "expect_revision", "expect_patterns", "expect_matches",
        "expect_pattern_probe", "expect_evidence_sha256",
    ],
    "reproduction_search": [
        "expect_subject_name", "expect_queries", "expect_total_results",
        "expect_adjudicated_positive", "expect_response_digests",
    ],
}
SUBJECT_FIELDS = [
    "id", "repo", "kind", "sources", "axis_sources", "axis_documents", "axis_method",
    "axis_literals", "axis_file", "axis_evidence_sha256", "note", "superseded_sources",
    "source_warrant",
]
MIN_LITERAL_CHARS = 4
STUB_BYTES = 512
VOLATILE_KEYS = [
    "downloads", "downloadsAllTime", "likes", "spaces", "trendingScore", "usedStorage",
    "lastModified", "createdAt", "inference", "widgetData", "safetensors",
]
HIT_AXES = {16: "bit-identical", 17: "approximate"}
# -------------------------------------------------------------------------------------

AXIS_IDS = [a[0] for a in AXES]
NA_AXES = [a[0] for a in AXES if a[3]]
# least common multiple of 1..22: with it every score fraction is an exact integer
SCORE_UNIT = 232792560


def literal_map(values: dict) -> Column:
    parts = []
    for key, value in values.items():
        parts.append(F.lit(key))
        parts.append(F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value))
    return F.create_map(*parts)


def lookup(values: dict, key: Column) -> Column:
    """Literal dimension lookup; a key that is not there gives null (never a default)."""
    return F.try_element_at(literal_map(values), key)


def axis_name(axis: Column) -> Column:
    return lookup({a: name for a, _, name, _ in AXES}, axis)


def axis_group(axis: Column) -> Column:
    return lookup({a: group for a, group, _, _ in AXES}, axis)


def group_name(group: Column) -> Column:
    return F.coalesce(lookup(GROUPS, group), F.lit("ungrouped"))


def level_name(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").otherwise(F.coalesce(lookup(LEVELS, score), F.lit("UNKNOWN")))


def is_axis(axis: Column) -> Column:
    return axis.isNotNull() & axis.isin(AXIS_IDS)


def max_for(axis: Column, kind: Column) -> Column:
    """Highest attainable score of an axis for a release of this kind."""
    cap = F.coalesce(lookup(AXIS_MAX, axis), F.lit(2))
    for stratum, caps in STRATUM_MAX.items():
        stratum_cap = F.coalesce(lookup(caps, axis), F.lit(2))
        cap = F.when(kind.eqNullSafe(stratum), F.least(cap, stratum_cap)).otherwise(cap)
    return cap


def is_registered(method: Column) -> Column:
    return F.coalesce(method.isin(METHODS), F.lit(False))


def has_executor(method: Column) -> Column:
    return is_registered(method) & ~method.isin(METHODS_WITHOUT_EXECUTOR)


def is_permitted(method: Column, axis: Column) -> Column:
    return F.coalesce(F.array_contains(lookup(PERMITTED_AXES, method), axis), F.lit(False))


def required_method(axis: Column) -> Column:
    return lookup(REQUIRED_METHOD, axis)


def required_fields(method: Column) -> Column:
    return F.coalesce(lookup(REQUIRED_FIELDS, method), F.array().cast("array<string>"))


def cost_of(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Attach what an axis would cost a publisher; a missing entry is flagged, never blank."""
    return rows.join(costs.select("axis", "cost"), "axis", "left").withColumn("cost_missing", F.col("cost").isNull())


# --- the same tables as small DataFrames (for users who want to join or print them) ---
