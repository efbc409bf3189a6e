"""Classifiers of changed-file paths as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: path conventions that results depend on. ---
NOISE_EXACT = ("Makefile",)
NOISE_ENDS = ("go.mod", "go.sum")
NOISE_STARTS = (".github/workflows",)
NOISE_PARTS = ("/testdata/golden/",)
BUNDLE = r"^tool/data/[^/]+-bundle\.tgz\z"
COMPONENTS = (
    (r"^instrumentation/", "instrumentation"),
    (r"^tool/(?:internal/)?([^/]+)", "tool/$1"),
    (r"^pkg/", "pkg/runtime"),
    (r"^docs/", "docs"),
    (r"^test/", "test/e2e"),
    (r"^\.github/", "ci"),
    (r"^(scripts|\.tools)/", "build"),
    (r"^demo/", "demo"),
    (r"^schemas/", "semconv"),
)
INTEGRATION = r"^instrumentation/(?:[^/]*\.[^/]*/)?([^/]+)"
TARGET_PATH = r"^instrumentation/(.+?)/(?:v\d+/)?[^/]+\z"
HOST_ENDING = r"\.(com|org|io|net)\z"
TARGET_SEEDS = ("grpc", "http", "sql", "https")
# --- End of fixed values. ---


def is_bundle(path: Column) -> Column:
    return path.rlike(BUNDLE)


def is_noise(path: Column, exact: Sequence[str] = NOISE_EXACT, ends: Sequence[str] = NOISE_ENDS, starts: Sequence[str] = NOISE_STARTS, parts: Sequence[str] = NOISE_PARTS) -> Column:
    """Files that change together by accident and say nothing about duplication."""
    out = is_bundle(path) | path.isin(*exact)
    for e in ends:
        out |= path.endswith(e)
    for s in starts:
        out |= path.startswith(s)
    for p in parts:
        out |= path.contains(p)
    return out


def signal_files(files: Column) -> Column:
    """Distinct files that are not noise, in first-seen order; null counts as none."""
    return F.array_distinct(F.filter(F.coalesce(files, F.array().cast("array<string>")), lambda f: ~is_noise(f)))


def component(path: Column) -> Column:
    """The first component whose pattern matches, or null."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(COMPONENTS):
        label = F.concat(F.lit(name[:-2]), F.regexp_extract(path, pattern, 1)) if name.endswith("$1") else F.lit(name)
        out = F.when(path.rlike(pattern), label).otherwise(out)
    return out


def integration(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, INTEGRATION, 1), F.lit(""))


def targets_of(path: Column) -> Column:
    """Array of the target names in an instrumentation path."""
    segments = F.split(F.regexp_extract(path, TARGET_PATH, 1), "/")
    names = F.transform(segments, lambda s: F.regexp_replace(F.lower(s), HOST_ENDING, ""))
    return F.filter(names, lambda s: (F.length(s) > 2) & ~s.rlike(r"^v\d+\z") & ~s.contains("."))
