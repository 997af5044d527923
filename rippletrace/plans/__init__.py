"""Physical strategies: durable intermediates, hot-key-safe running values, traversal."""

from .blocks import running, sequence_number  # noqa: F401
from .durable import materialize, scratch_root, stored  # noqa: F401
from .frontier import reach_set, trace_back  # noqa: F401
