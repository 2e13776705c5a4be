"""Registered queries: the library's operators over the given tables, with SQL oracles."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("pixel_queries", "scene_queries", "evidence_queries", "retrieval_queries", "quality_queries", "geometry_queries", "streaming_queries")


def load():
    """All registered queries by name."""
    for family in FAMILIES:
        import_module(f"workloads.{family}")
    return import_module("workloads.registry").QUERIES
