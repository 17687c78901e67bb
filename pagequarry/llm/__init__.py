"""Operators for preparing training text, each over whole tables of documents or pages."""

import sys

from pyspark import cloudpickle

# Functions and classes travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
