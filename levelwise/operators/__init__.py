"""DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code: executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
