"""Registered queries and compositions."""

from . import (queries_diagnose, queries_eda, queries_encodings, queries_features, queries_fusion, queries_metrics, queries_tables, queries_training)  # noqa: F401
from .registry import QUERIES  # noqa: F401
