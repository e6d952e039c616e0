"""Operators for large training corpora; nothing else in the package imports this subpackage.

Functions of this subpackage travel to the executors by value, so the executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
