"""Analytics over collections of small labelled graphs, and over text, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
