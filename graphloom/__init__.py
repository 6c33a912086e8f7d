"""graphloom: connected components and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Executors get the code of this package inside the tasks; nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from graphloom.plans.api import component_sizes, connected_components, with_roots  # noqa: E402
from graphloom.plans.metrics import RunMetrics  # noqa: E402

__all__ = ["RunMetrics", "component_sizes", "connected_components", "with_roots"]
