"""Record-flow and run-log analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from sluiceflow.flow import Flow  # noqa: E402
from sluiceflow.session import build_session, materialize  # noqa: E402

__all__ = ["Flow", "build_session", "materialize"]
