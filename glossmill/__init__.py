"""Corpus statistics, lexicon-driven rewriting and document conversion on Spark DataFrames.

Functions that run on executors are pickled by value, so executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

VERSION = "0.3"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
