"""Operations of a training-data pipeline: ten operators over documents, pages, vectors and conversations.

Functions that run in Python tasks are sent to the executors by value, so that workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
