"""Registered queries over the given tables, each with its SQL where SQL can express it."""

import importlib

FAMILIES = ("evaluate", "prepare", "arrange", "fit", "learn", "audit")


def catalog():
    for f in FAMILIES:
        importlib.import_module(f"evenhand.plans.{f}")
    from evenhand.plans.registry import REGISTRY

    return dict(REGISTRY)
