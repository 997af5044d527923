"""Column expressions shared by the operators."""

from .columns import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
