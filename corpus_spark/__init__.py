"""PySpark engine for preparing, translating and scoring parallel text corpora."""

import sys

from pyspark import cloudpickle

# Ship the package's functions inside the tasks, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
