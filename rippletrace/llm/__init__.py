"""Operators for preparing training text; nothing outside this subpackage imports it.

Functions that run on executors are shipped by value, so a cluster needs no copy of this
package (the libraries they use have to be there).
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
