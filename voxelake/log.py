"""Debug messages of the engine, by component, through the standard logging module.

Silent unless asked for: `enable()` shows them on stderr, or any handler on the logger "voxelake".
Messages come from the driver and from tasks alike; no value of a dataset is ever logged.
"""

from __future__ import annotations

import logging
import sys

ROOT = "voxelake"
logging.getLogger(ROOT).addHandler(logging.NullHandler())


def logger(component: str) -> logging.Logger:
    """The logger of a component, such as reader, writer or pixels."""
    return logging.getLogger(f"{ROOT}.{component}")


def enable(level: int = logging.DEBUG, stream=None) -> logging.Handler:
    """Show messages from `level` on; returns the handler, for `disable`."""
    h = logging.StreamHandler(stream or sys.stderr)
    h.setFormatter(logging.Formatter("%(levelname)s component=%(name)s %(message)s"))
    root = logging.getLogger(ROOT)
    root.addHandler(h)
    root.setLevel(level)
    return h


def disable(handler: logging.Handler) -> None:
    root = logging.getLogger(ROOT)
    root.removeHandler(handler)
    root.setLevel(logging.NOTSET)
