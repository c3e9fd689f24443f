"""Source-code analytics over corpora of repositories, as Spark jobs.

Every table carries a leading ``repo`` column; one checkout is one value of it.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
