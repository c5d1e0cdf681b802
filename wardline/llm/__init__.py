"""Operators for training-data pipelines; nothing else in the library imports them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
