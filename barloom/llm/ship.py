"""Worker code travels with the task, so that executors need no copy of this package."""

import sys

from pyspark import cloudpickle


def by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
