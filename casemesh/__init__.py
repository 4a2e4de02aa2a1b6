"""casemesh: dataframe operators for case files, evidence documents and audit trails."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
