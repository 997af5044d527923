"""Graph, event-log and ownership operators."""

from . import (  # noqa: F401
    ancestry, closure, cycles, diff, impact, integrity, links, ownership, resolve, scores, temporal, view,
)
