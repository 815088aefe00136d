"""Operators for preparing training data; nothing else in the library imports this package.

Functions of this package travel to Python workers by value, so a cluster needs no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
