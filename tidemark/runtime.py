"""Driver-side helpers for runs: clocks, deadlines, cancellation, and an executor that records instead of running."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


class ManualClock:
    """A clock that only moves when told to; ticks adds that much at each reading."""

    def __init__(self, start: float = 0.0, ticks: float = 0.0):
        self.at, self.ticks = float(start), float(ticks)

    def __call__(self) -> float:
        self.at += self.ticks
        return self.at

    def advance(self, seconds: float) -> float:
        if seconds < 0:
            raise ValueError("time doesn't go back")
        self.at += seconds
        return self.at

    sleep = advance


class OffsetClock:
    """Another clock, shifted."""

    def __init__(self, offset: float, clock: Callable[[], float] = time.time):
        self.offset, self.clock = offset, clock

    def __call__(self) -> float:
        return self.clock() + self.offset


@dataclass(frozen=True)
class Deadline:
    """A moment on a clock; no moment means never."""

    clock: Callable[[], float]
    at: float | None = None

    @classmethod
    def after(cls, clock: Callable[[], float], seconds: float | None) -> Deadline:
        return cls(clock, None if seconds is None else clock() + seconds)

    @property
    def remaining(self) -> float | None:
        return None if self.at is None else max(0.0, self.at - self.clock())

    @property
    def expired(self) -> bool:
        return self.at is not None and self.clock() >= self.at


@dataclass
class CancelToken:
    """A flag that is set once; listeners hear of it once, those that come later at once."""

    reason: str | None = None
    listeners: list[Callable[[str], None]] = field(default_factory=list)

    @property
    def cancelled(self) -> bool:
        return self.reason is not None

    def listen(self, listener: Callable[[str], None]) -> None:
        if self.cancelled:
            listener(self.reason)
        else:
            self.listeners.append(listener)

    def cancel(self, reason: str = "cancelled") -> bool:
        if self.cancelled:
            return False
        self.reason = reason
        for listener in self.listeners:
            listener(reason)
        return True


@dataclass
class Recorder:
    """Bodies for a dry run: each task's call is noted and answered from a script (a value, or an exception to raise)."""

    script: dict[str, object] = field(default_factory=dict)
    calls: list[tuple[str, int]] = field(default_factory=list)

    def body(self, name: str) -> Callable:
        def call(context):
            self.calls.append((name, context.attempt))
            answer = self.script.get(name)
            if isinstance(answer, BaseException):
                raise answer
            return answer

        return call

    def rehearse(self, workflow) -> None:
        """Put recorded bodies in place of a workflow's own."""
        for name, task in workflow.tasks.items():
            task.body = self.body(name)
