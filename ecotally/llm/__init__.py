"""Training-data operators: one module per operator, queries and SQL in
``queries.py``.

Nothing else in the library imports this package.  Its functions are shipped
to Python workers by value, so executors need no copy of the library on their
path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
