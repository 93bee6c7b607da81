"""Registered queries over the given tables, one module per part of the inventory."""

from importlib import import_module

PARTS = ("scans", "sinks", "geometry", "searches", "sorting", "joining", "counting", "windows", "logs", "suites", "streams")


def load():
    """Import every part once and return the registry."""
    for part in PARTS:
        import_module(f"granulake.plans.{part}")
    return import_module("granulake.plans.registry")
