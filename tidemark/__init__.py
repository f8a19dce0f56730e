"""Reactive, versioned document analytics on PySpark."""

import sys

from pyspark import cloudpickle

from tidemark.session import build_session

# Executors need not have the package installed: its small per-row helpers travel
# with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
