"""Queries of the engine on the test tables; importing a module here registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("scores", "dated", "quality", "texts", "audits", "validators", "misc")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
