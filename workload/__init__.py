"""Registered queries over the supplied tables, and their SQL counterparts."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# the stand-in models run inside tasks: ship them with the job
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from . import boards, feeds, pages, streams, texts  # noqa: E402,F401  (registers their queries)
from .catalog import ORACLES, QUERIES  # noqa: E402,F401
