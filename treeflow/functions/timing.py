"""Times of named steps."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Iterator

log = logging.getLogger("treeflow")


class TimingLog:
    """Seconds by name: with TimingLog.step("load"): ..."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextlib.contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            log.info("%s: %.3f s", name, took)
