"""Operators for preparing training data at scale.

Functions that run inside Python tasks are shipped by value, so executors need
nothing but Python with numpy, pandas and pyarrow: the package itself does not have
to be installed on them, and the working directory does not matter."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
