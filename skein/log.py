"""One logger for the driver's messages."""

from __future__ import annotations

import logging
import sys


def logger(name: str = "skein", level: int = logging.INFO) -> logging.Logger:
    """A logger to standard output with ISO dates; asking again gives the same one."""
    found = logging.getLogger(name)
    if not found.handlers:
        out = logging.StreamHandler(sys.stdout)
        out.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
        found.addHandler(out)
        found.setLevel(level)
        found.propagate = False
    return found
