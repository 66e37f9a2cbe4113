"""winnow: profile, prepare and score labelled tables with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from winnow.roles import Roles

# ship the few pandas helpers inside the task, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Roles"]
