"""Evidence-risk analytics on Spark DataFrames.

Functions that run on executors are sent by value, so that executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
