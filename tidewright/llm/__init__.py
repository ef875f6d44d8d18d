"""Corpus preparation operators for language-model training data.

Every operator takes and returns DataFrames, touches only the columns it names
(so extra or clashing columns are harmless) and is safe to recompute when an
executor is lost.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
