"""Rater agreement, fairness and example retrieval on large labelled-text tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
