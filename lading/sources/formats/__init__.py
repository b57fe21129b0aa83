"""One module for each container. A format lists members as rows and reads their content;
``MODULES`` maps a container's name to it."""

from __future__ import annotations

import importlib
from types import ModuleType

_OWN = {"zip": "zip", "tar": "tar", "7z": "sevenzip", "rar": "rar", "iso": "iso", "raw_stream": "single", "directory": "directory"}
MODULES = {container: f"{__name__}.{module}" for container, module in _OWN.items()}


def handler(container: str) -> ModuleType:
    """The module of a container: ``listing(src, archive)`` yields member rows, ``content(src, archive, wanted)`` yields (member row, chunks)."""
    return importlib.import_module(MODULES[container])


def register_format(container: str, module: str) -> None:
    """Adds a container: the full name of an importable module with ``listing``, ``content`` and ``cost``."""
    MODULES[container] = module
