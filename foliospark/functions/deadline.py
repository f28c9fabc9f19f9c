"""A time limit for pieces of Python work inside a task."""

from __future__ import annotations

import ctypes
import threading
import time


class TooLong(Exception):
    """The work was not done in time."""


class Deadline:
    """``with Deadline(s) as limit:`` and inside it ``with limit.turn():`` around each piece of work, which raises
    ``TooLong`` in its thread soon after ``s`` seconds. It comes between two steps of Python, so a single call into C is
    waited for. None waits for ever."""

    def __init__(self, seconds: float | None):
        self.seconds, self.due, self.lock, self.ended = seconds, None, threading.Lock(), threading.Event()

    def __enter__(self) -> Deadline:
        if self.seconds is not None:
            self.thread = ctypes.c_ulong(threading.get_ident())
            threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()

    def turn(self) -> _Turn:
        return _Turn(self)

    def _watch(self) -> None:
        while not self.ended.wait(min(self.seconds / 4, 0.5)):
            with self.lock:
                if self.due is not None and time.monotonic() > self.due:
                    self.due = None
                    ctypes.pythonapi.PyThreadState_SetAsyncExc(self.thread, ctypes.py_object(TooLong))


class _Turn:
    __slots__ = ("limit",)

    def __init__(self, limit: Deadline):
        self.limit = limit

    def __enter__(self) -> None:
        if self.limit.seconds is not None:
            with self.limit.lock:
                self.limit.due = time.monotonic() + self.limit.seconds

    def __exit__(self, *_) -> None:
        with self.limit.lock:
            self.limit.due = None
        for _ in range(2):  # an interruption that is under way comes here at the latest
            pass
