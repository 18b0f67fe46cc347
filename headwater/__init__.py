"""headwater: SQL lineage and catalog analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with the plan, so the package needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
