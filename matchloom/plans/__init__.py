"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

MODULES = ("timeline", "joins", "combat", "reports", "context", "texts", "knowledge", "guard", "pipeline", "streams")


def load():
    for name in MODULES:
        import_module(f"matchloom.plans.{name}")
    return import_module("matchloom.plans.registry")
