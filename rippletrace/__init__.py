"""Dependency-impact analytics on Spark DataFrames.

Every table carries ``repo_id``; every operator is DataFrame in, DataFrame out.
"""

from . import functions, operators, plans, sources, streaming  # noqa: F401
from .session import recommended_conf  # noqa: F401
