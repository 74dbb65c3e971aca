"""Registered queries over the logical tables."""

from . import catalog, composed, detections, evaluation, retrieval, streams, text  # noqa: F401
