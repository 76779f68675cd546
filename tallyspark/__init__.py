"""Company benchmarking and filing analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
