"""evalspark: DataFrame operators for chat, evaluation, retrieval, label and telemetry tables."""

import sys

from pyspark import cloudpickle

# Functions handed to Arrow UDFs travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
