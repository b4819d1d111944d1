"""Spark operators for dated table snapshots (daily feeds of keyed CSV files)."""

import sys

from pyspark import cloudpickle

from feedops.session import build_session

__all__ = ["build_session"]

# task functions travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
