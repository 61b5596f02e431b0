"""quantloom: a PySpark-native engine for ordered OHLCV series.

Importing the package registers it with PySpark's cloudpickle so that functions shipped to
executors travel by value: executors need numpy, pandas and pyarrow, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
