"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage.

Every operator takes a DataFrame and the names of its columns, reads those columns only and returns new columns beside the
id, so extra columns of any name do no harm. Functions that run inside tasks are pickled by value: executors need the
third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
