"""ticketloom: support-desk analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame, built on native Spark expressions; Python runs inside tasks
only where an expression cannot state the rule (chunking, dense products). Operators that read a result more than once
write it to the shared folder first, so calling them may run jobs.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
