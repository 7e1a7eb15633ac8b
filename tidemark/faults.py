"""The errors that the engine raises on purpose. Each kind has a stable code, and a family that decides the exit code."""

from __future__ import annotations


class Fault(ValueError):
    """Base of all. details are whatever helps a program to react: names, limits, what was expected."""

    code, family = "engine_error", "definition"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def as_dict(self) -> dict:
        """For logs and the command line."""
        out = {"code": self.code, "family": self.family, "message": self.message}
        return out | ({"details": dict(sorted(self.details.items()))} if self.details else {})


class ExpressionError(Fault):
    """A fault in an expression, with its source and place."""

    def __init__(self, message: str, source: str = "", at: int = 0):
        super().__init__(f"{message} (at {at})" if source else message, source=source, at=at)
        self.message, self.source, self.at = message, source, at

    def render(self) -> str:
        """The source, and a caret under the place."""
        return f"{self.source}\n{' ' * self.at}^ {self.message}"


class DefinitionError(Fault):
    """A definition's fault; issues lists all of them if it was checked as a whole."""

    def __init__(self, message: str, issues: list = (), **details):
        super().__init__(message, **details)
        self.issues = list(issues)


class RunFailed(Fault, RuntimeError):
    """A run that did not succeed."""


#: Code of each kind and, from one line to the next, the kind that it belongs to. Families are inherited.
ExpressionError.code, DefinitionError.code = "expression_error", "workflow_definition_error"
RunFailed.code, RunFailed.family = "task_failed", "execution"


def _kind(name: str, base: type[Fault], code: str, family: str | None = None) -> type[Fault]:
    return type(name, (base,), {"code": code, "__module__": __name__} | ({"family": family} if family else {}))


ConfigurationError = _kind("ConfigurationError", Fault, "configuration_error")
DuplicateTask = _kind("DuplicateTask", DefinitionError, "duplicate_task")
UnknownTask = _kind("UnknownTask", DefinitionError, "unknown_task")
DependencyCycle = _kind("DependencyCycle", DefinitionError, "dependency_cycle")
ValidationFailed = _kind("ValidationFailed", DefinitionError, "validation_failed")
PoolError = _kind("PoolError", DefinitionError, "pool_error")
UnknownPool = _kind("UnknownPool", PoolError, "unknown_pool")
ResourceCapacity = _kind("ResourceCapacity", PoolError, "resource_capacity")
ParameterError = _kind("ParameterError", ConfigurationError, "parameter_error")
MissingParameter = _kind("MissingParameter", ParameterError, "missing_parameter")
ParameterType = _kind("ParameterType", ParameterError, "parameter_type")
ExpressionSyntax = _kind("ExpressionSyntax", ExpressionError, "expression_syntax")
ExpressionEvaluation = _kind("ExpressionEvaluation", ExpressionError, "expression_evaluation")
UnknownFunction = _kind("UnknownFunction", ExpressionError, "unknown_function")
UnknownVariable = _kind("UnknownVariable", ExpressionError, "unknown_variable")
ScheduleError = _kind("ScheduleError", Fault, "schedule_error")
CronSyntax = _kind("CronSyntax", ScheduleError, "cron_syntax")
ExecutionError = _kind("ExecutionError", Fault, "execution_error", "execution")
TaskTimeout = _kind("TaskTimeout", ExecutionError, "task_timeout")
RunCancelled = _kind("RunCancelled", RunFailed, "run_cancelled")
IllegalTransition = _kind("IllegalTransition", ExecutionError, "illegal_transition")
StoreError = _kind("StoreError", Fault, "store_error", "storage")
UnknownRun = _kind("UnknownRun", StoreError, "unknown_run")
CorruptLog = _kind("CorruptLog", StoreError, "event_log_corrupt")
