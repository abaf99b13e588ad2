"""Spark data-quality and anomaly library for healthcare-style tables."""

import sys

from pyspark import cloudpickle

from wardenframe.session import build_session

# Functions of this package travel to Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
