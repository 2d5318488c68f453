"""strandline: k-mer genotyping and call-set operations as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
