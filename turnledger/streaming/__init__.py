"""Structured Streaming jobs over landed log files and log-shaped tables."""

import sys

from pyspark import cloudpickle

# the keyed state travels with its tasks: neither executors nor the driver's Python runner need an installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
