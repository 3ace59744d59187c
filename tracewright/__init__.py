"""tracewright: analytics over multi-agent run logs, written for Spark."""

import sys

from pyspark import cloudpickle

# what runs inside tasks is pickled by value, so executors need the public libraries only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
