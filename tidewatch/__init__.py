"""tidewatch: market-attention analytics as Spark DataFrame operators.

Articles, ticker mentions and a ticker dimension go in; attention boards,
ticker pages, search results and de-duplicated feeds come out.  Every public
function takes and returns DataFrames (or Columns) and plans lazily unless its
docstring says otherwise.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship the few functions that run inside tasks with the job itself, so that
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
