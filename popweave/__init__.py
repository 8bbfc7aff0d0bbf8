"""popweave: synthetic-population analytics on Spark DataFrames.

Records are counted once into a cell table (one partial-aggregated
``groupBy``); marginals, joints, metrics and fits all run on that bounded
table; sampling and expansion go back to record scale through range joins
against ``spark.range`` so no task ever holds a whole cell or group.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers (the in-task fits) are pickled by value,
# so executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from popweave.domain import (  # noqa: E402,F401
    CENSUS_ATTRS,
    CENSUS_DOMAIN,
    DISPLAY_NAMES,
    POP_ATTRS,
    POP_DOMAIN,
)

__all__ = ["CENSUS_ATTRS", "CENSUS_DOMAIN", "DISPLAY_NAMES", "POP_ATTRS", "POP_DOMAIN"]
