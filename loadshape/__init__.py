"""loadshape: metered time series on PySpark.

Every operator is a plain function from DataFrames to a DataFrame and works on
many series at once.  A series is named by ``keys`` (one or more columns) and
ordered by ``ts``, or by its 0-based position ``seq``.
"""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the job, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
