"""opsframe: PySpark operators for messy operational tables.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Rules and options are ordinary Python dicts; the rows
stay on the executors.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run on executors travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
