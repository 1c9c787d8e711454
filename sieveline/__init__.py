"""Static content triage on Spark: fingerprints, detectors, scores and reports as DataFrame operations."""

from .config import TriageOptions
from .plans.triage import explode_issues, scan, scan_relation, scan_targets

__all__ = ["TriageOptions", "explode_issues", "scan", "scan_relation", "scan_targets"]
__version__ = "0.1.0"
