"""Operators for preparing training text at scale; each module states its method and its edges.

Functions of this subpackage that run in Python workers are sent with their code, so executors
need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
