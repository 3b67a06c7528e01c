"""Work in a child process that can be ended from outside: native code that hangs or aborts costs its own item only."""

from __future__ import annotations

import contextlib
import ctypes
import os
import pickle
import select
import signal
import struct
import time
import warnings
from collections.abc import Callable, Iterator

_END = 0xFFFFFFFF


class ChildError(Exception):
    """Why a child gave no full result: ``subprocess_timeout_Ns``, ``subprocess_exit_N``, ``subprocess_missing_output``, ``subprocess_invalid_output_X`` or ``process_exception_X``."""


def _child(work: Callable[[], Iterator], out: int) -> None:
    with os.fdopen(out, "wb", buffering=0) as pipe:
        try:
            for item in work():
                blob = pickle.dumps((True, item))
                pipe.write(struct.pack("<I", len(blob)) + blob)
        except Exception as e:  # noqa: BLE001 - reported by name
            blob = pickle.dumps((False, type(e).__name__))
            pipe.write(struct.pack("<I", len(blob)) + blob)
        pipe.write(struct.pack("<I", _END))


def _end_with_parent() -> None:
    """A child does not outlive a worker that is lost (on Linux; elsewhere it ends when it next writes)."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).prctl(1, signal.SIGKILL)


def in_child(work: Callable[[], Iterator], timeout: float | None = None) -> Iterator:
    """The items of ``work()``, made by a forked child and passed on as they come; raises ``ChildError`` where it fails or takes longer than ``timeout`` seconds in all.

    Whatever happens the child is gone afterwards, also where the caller stops early.
    """
    ours, theirs = os.pipe()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)  # forks beside threads: the child runs the work alone
        pid = os.fork()
    if pid == 0:
        code = 1
        try:
            os.close(ours)
            _end_with_parent()
            _child(work, theirs)
            code = 0
        finally:
            os._exit(code)
    os.close(theirs)
    until = None if timeout is None else time.monotonic() + timeout
    ended = status = None

    def read(n: int) -> bytes:
        held = bytearray()
        while len(held) < n:
            left = None if until is None else until - time.monotonic()
            if left is not None and (left <= 0 or not select.select([ours], [], [], left)[0]):
                raise ChildError(f"subprocess_timeout_{timeout:g}s")
            part = os.read(ours, min(n - len(held), 1 << 20))
            if not part:
                break
            held += part
        return bytes(held)

    try:
        while True:
            head = read(4)
            if len(head) < 4:
                break
            size = struct.unpack("<I", head)[0]
            if size == _END:
                ended = True
                break
            blob = read(size)
            if len(blob) < size:
                break
            try:
                good, item = pickle.loads(blob)
            except Exception as e:  # noqa: BLE001 - what the child wrote is no result
                raise ChildError(f"subprocess_invalid_output_{type(e).__name__}") from e
            if not good:
                raise ChildError(f"process_exception_{item}")
            yield item
        if not ended:
            status = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
            raise ChildError(f"subprocess_exit_{status}" if status else "subprocess_missing_output")
    finally:
        os.close(ours)
        if status is None:
            with contextlib.suppress(ProcessLookupError):
                os.kill(pid, signal.SIGKILL)
            os.waitpid(pid, 0)
