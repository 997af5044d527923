"""Readers for snapshots, event logs and source trees, and their writers."""

from . import events, manifests, scan, snapshot, tree  # noqa: F401
