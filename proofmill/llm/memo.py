"""Tables that a Python worker keeps between tasks, and memory given back after them.

A worker keeps one operator's tables at a time. They are dropped when another
operator's task begins, and when no task has used them for ``IDLE`` seconds, so a
stage without Python doesn't carry what an earlier one left. Tables are ``Recent``:
bounded, and what is used again outlives what is met once.
"""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa

IDLE = 2.0
_holders: dict[str, Callable[[], None]] = {}
_lock = threading.RLock()
_running = 0
_timer: threading.Timer | None = None


class Recent:
    """Two generations of at most ``most`` entries: a full one ages, and what is then looked up moves to the new one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.new[key] = value
        return value

    def turn(self) -> None:
        """Let the new generation age if it is full."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


def keeps(name: str, clear: Callable[[], None]) -> None:
    _holders[name] = clear


def give_back() -> None:
    """Return freed memory to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _drop(but: str | None = None) -> None:
    for name, clear in _holders.items():
        if name != but:
            clear()


def _rested() -> None:
    with _lock:
        if not _running:
            _drop()
            gc.collect()
            give_back()


def run_task(name: str, run: Callable[[Iterator], Iterator], batches: Iterator) -> Iterator:
    global _running, _timer
    with _lock:
        _running += 1
        if _timer is not None:
            _timer.cancel()
            _timer = None
        _drop(name)
    try:
        yield from run(batches)
    finally:
        with _lock:
            _running -= 1
            if _holders and not _running:
                _timer = threading.Timer(IDLE, _rested)
                _timer.daemon = True
                _timer.start()
            give_back()


def task(name: str = "") -> Callable:
    """Marks the function of a mapInArrow: it uses the tables called ``name`` (none: no table at all)."""

    def mark(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        def running(batches: Iterator) -> Iterator:
            # pickled with the task; the worker's own module holds the state
            from proofmill.llm import memo

            yield from memo.run_task(name, run, batches)

        return running

    return mark
