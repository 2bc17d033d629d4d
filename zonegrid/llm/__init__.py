"""Operators for training-data pipelines. Nothing else in the package imports this.

Functions of this subpackage that run inside tasks are sent by value, so the
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
