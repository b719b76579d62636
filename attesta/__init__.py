"""attesta: a provenance-first catalogue engine on PySpark DataFrames.

functions/  Column in, Column out
operators/  DataFrame in, DataFrame out
sources/    declared scans and append-only / versioned sinks
plans/      whole runs, and the queries registered for the checks
streaming/  Structured Streaming forms of the recurring jobs
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
