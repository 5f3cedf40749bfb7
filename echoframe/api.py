"""What users import: detectors, encoders, the gate and the extension point."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .config import CloneConfig, RepositoryOptions, options_from_json
from .operators.families import Families, families_for_pairs, family_tables
from .plans.accuracy import AccuracyGate
from .plans.detector import CloneReport, detect_files, detect_fragments
from .plans.detector import detect_repository as _detect_repository
from .plans.encode import SCHEMA_ID, json_schema, to_bigcloneeval, to_json, to_sarif, write_bigcloneeval, write_json, write_sarif, write_text
from .sources.repository import fragments_from_json

__all__ = [
    "AccuracyGate", "CloneConfig", "CloneReport", "Families", "Report", "RepositoryOptions", "SCHEMA_ID", "SemanticCandidateProvider", "detect_files",
    "detect_fragments", "detect_json_fragments", "detect_repository", "families_for_pairs", "family_tables", "json_schema", "to_bigcloneeval", "to_json", "to_sarif",
    "write_bigcloneeval", "write_json", "write_sarif", "write_text",
]


class SemanticCandidateProvider(Protocol):
    """An extension that proposes candidates by meaning: ``detect_fragments(..., provider=...)``
    joins them into verification beside those that share fingerprints."""

    def candidates(self, fragments: DataFrame, limit: int) -> DataFrame:
        """(fragment_id, candidate_id), at most ``limit`` per fragment."""


class Report:
    """A report with the counts and encodings of the JSON interface."""

    def __init__(self, report: CloneReport):
        self.report = report

    @property
    def pair_count(self) -> int:
        return self.report.statistics.first().verified_pairs

    @property
    def family_count(self) -> int:
        return self.report.family_tables.sizes.count()

    def to_json_string(self) -> str:
        return to_json(self.report)

    def to_json(self) -> dict:
        return json.loads(self.to_json_string())

    def to_sarif(self) -> str:
        return to_sarif(self.report)

    def to_bigcloneeval(self) -> str:
        return to_bigcloneeval(self.report)


def detect_repository(spark: SparkSession, root: str, options: dict | None = None) -> Report:
    """Clones below a folder; options by their camel-case names."""
    config, repository = options_from_json(options or {})
    return Report(_detect_repository(spark, root, config, repository))


def detect_json_fragments(spark: SparkSession, fragments: list[dict], options: dict | None = None) -> Report:
    """Clones among fragments given as JSON objects."""
    config, _ = options_from_json(options or {})
    return Report(detect_fragments(fragments_from_json(spark, fragments), config))
