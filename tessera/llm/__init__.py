"""Operators for large training-text corpora.

Each module holds one operator; ``queries.py`` registers one query per
operator.  Nothing outside this subpackage imports it.  Functions that run
inside Python workers are shipped by value, so executors need no copy of the
library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
