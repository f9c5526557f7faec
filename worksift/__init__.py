"""Worksift: risk-ranked public-works analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helpers used inside pandas UDFs travel with the task instead of having to be
# installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
