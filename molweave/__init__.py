"""Molecular screening analytics as Spark jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# the small Arrow kernels travel with their jobs, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
