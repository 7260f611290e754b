"""Registered queries over the driver tables."""

from . import q_labels, q_metrics, q_sources, q_spatial, q_splits, q_wavelet, q_windowing  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
