"""News ingestion and text analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The Arrow helpers travel inside the tasks, so executors need no installed
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
