"""Governed analytics on Spark: profile, metric catalog, fixed statistics, joins, PII, verification.

Every operator takes and returns DataFrames and stays lazy unless its docstring says otherwise.
"""

from tallyward.dataset import Dataset
from tallyward.session import build_session, checkpoint_root

__all__ = ["Dataset", "build_session", "checkpoint_root"]
