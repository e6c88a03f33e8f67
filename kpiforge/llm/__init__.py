"""Operators of a training-data pipeline (packing, near duplicates, archives,
sharding, tokens, search, language ID, line de-duplication).

Nothing else in the library imports this subpackage.  Its functions run in
Python workers too, so the whole subpackage is shipped by value: workers
need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
