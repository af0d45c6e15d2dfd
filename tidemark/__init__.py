"""tidemark: metrics, forecasts and anomalies over lakehouse tables, as Spark plans."""

import sys

from pyspark import cloudpickle

from tidemark.session import get_session, work_dir

# functions that run in tasks travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "work_dir"]
