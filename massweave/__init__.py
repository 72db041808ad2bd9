"""Feature-table linkage and the data processing around it, on Spark DataFrames."""

from massweave.config import StatTestParams, Tolerances
from massweave.operators.results import MatchResult
from massweave.operators.roles import ColumnMap, infer_column_map
from massweave.plans.align import PeakMatcher, align

__version__ = "0.1.0"
__all__ = ["ColumnMap", "MatchResult", "PeakMatcher", "StatTestParams", "Tolerances", "align", "infer_column_map"]
