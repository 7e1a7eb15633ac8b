"""Families of errors and the exit codes that they have on the command line."""

from __future__ import annotations

from tidemark.faults import Fault

#: Exit codes.
OK, RUN_FAILED, USAGE, DEFINITION, STORAGE, INTERRUPTED = 0, 1, 2, 3, 4, 130
#: code and family of errors that aren't the engine's own; the first that fits counts.
FOREIGN: list[tuple[type[BaseException], str, str]] = [(FileNotFoundError, "store_error", "storage"), (ValueError, "configuration_error", "definition")]


def classify(error: BaseException) -> tuple[str, str]:
    """(code, family) of an error."""
    if isinstance(error, Fault):
        return error.code, error.family
    return next(((code, family) for kind, code, family in FOREIGN if isinstance(error, kind)), ("unknown", "definition"))


def exit_code(error: BaseException) -> int:
    if isinstance(error, KeyboardInterrupt):
        return INTERRUPTED
    return {"storage": STORAGE, "execution": RUN_FAILED}.get(classify(error)[1], DEFINITION)
