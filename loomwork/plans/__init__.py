"""Registered queries, grouped by subject."""

import importlib

_MODULES = ("corpus", "tokens", "chats", "taskdata", "packs", "evals", "logs", "storage", "streams")

for _name in _MODULES:
    importlib.import_module(f"{__name__}.{_name}")
