"""Training-data operators: one module per operator, their queries in ``queries``."""

import sys

from pyspark import cloudpickle

# tasks carry these helpers with them: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
