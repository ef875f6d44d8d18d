"""Spark-native analytics over session timelines: chat, transcripts, chapters, windows, clips and arcs."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
