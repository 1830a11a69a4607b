"""Assayline: build and judge text classifiers on labelled corpora, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to tasks carry their own code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
