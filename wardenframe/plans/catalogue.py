"""Imports every query module once and hands out the register."""

from __future__ import annotations

import importlib

from wardenframe.plans.registry import REGISTRY, Query

MODULES = (
    "pharmacy",
    "headers",
    "validation",
    "preparation",
    "sketches",
    "claims",
    "prescriber",
    "authorization",
    "serving",
    "models",
    "fusion",
    "knowledge",
    "files",
    "streams",
)


def load_catalogue() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"wardenframe.plans.{module}")
    return REGISTRY
