"""Frame selection for fleets of 360-degree walks, as Spark DataFrame jobs.

Every operator takes and returns DataFrames. State is partitioned by walk, and
no operator assumes that a walk, a group of duplicates or a job fits in one
task.
"""

import sys

from pyspark import cloudpickle

# Kernels run in Python workers that may not have this package installed, so
# they travel by value with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
