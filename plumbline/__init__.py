"""Tabular learning on Spark: profile, clean, select, search, evaluate, score."""

import sys

from pyspark import cloudpickle

from plumbline.config import Settings, Thresholds

__all__ = ["Settings", "Thresholds"]

# Tasks get the package's functions with the job itself, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
