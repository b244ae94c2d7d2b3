"""Importing this module registers every query."""

from __future__ import annotations

import importlib

MODULES = ("frame_queries", "voxel_queries", "key_queries", "minimap_queries", "vector_queries", "metadata_queries",
           "spatial_queries", "inventory_queries", "blob_queries", "audit_queries", "source_queries", "metric_queries",
           "build_queries", "stream_queries")

for _name in MODULES:
    importlib.import_module(f"embedmap.plans.{_name}")

from embedmap.plans.registry import CHECKS, QUERIES  # noqa: E402,F401
