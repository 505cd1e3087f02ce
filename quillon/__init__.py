"""quillon: coordination-review analytics on PySpark DataFrames."""

from quillon.model import CandidatePolicy

__all__ = ["CandidatePolicy"]
