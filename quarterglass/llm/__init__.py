"""Operators of a training-data pipeline over documents, pages and their labels.

The functions that run in Python tasks are pickled by value, so executors need the listed libraries but no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
