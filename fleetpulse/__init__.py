"""Device-health analytics as PySpark DataFrame operators.

Sub-packages:

* ``functions``  - column expressions (no shuffles, all JVM-side)
* ``sources``    - scans, imports and sinks
* ``operators``  - DataFrame -> DataFrame building blocks
* ``plans``      - composites: interface, device, daily, label and training tables
* ``streaming``  - the day-by-day incremental state and its checks
* ``catalog``    - the registered queries and their SQL counterparts
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
