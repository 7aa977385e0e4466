"""Quiz-funnel and conversion analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle

# functions that run on executors travel with the query, so a cluster needs no
# installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quizlens.tables import Stored, Tables  # noqa: E402

__all__ = ["Stored", "Tables"]
