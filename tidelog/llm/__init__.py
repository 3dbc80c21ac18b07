"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Functions that run in Python workers
are shipped by value, so that a cluster needs no installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
