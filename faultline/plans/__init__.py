"""Registered queries, one module per group of operators."""

from __future__ import annotations

import importlib

GROUPS = ("lines", "errors", "records", "triage", "mining", "corpus", "stream")


def load():
    """Import every group and return the registry they filled."""
    from faultline.plans import registry

    for group in GROUPS:
        importlib.import_module(f"faultline.plans.{group}_queries")
    return registry
