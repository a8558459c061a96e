"""Errors with the numeric codes of the API."""


class EngineError(Exception):
    code = 50001

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.message = message
        if code is not None:
            self.code = code


class InvalidExpr(EngineError):
    code = 50008


class NotImplementedExpr(EngineError):
    code = 50009


class InvalidPayload(EngineError):
    code = 50400


class InvalidName(EngineError):
    code = 50101


class InvalidRecord(EngineError):
    code = 50006


class NotFound(EngineError):
    code = 50003


class TableNotFound(EngineError):
    code = 50005


class DatabaseExists(EngineError):
    code = 50031


class TableExists(EngineError):
    code = 50004


class Unsupported(EngineError):
    code = 50002


class Conflict(EngineError):
    """Another writer has committed first."""


class NotLeader(EngineError):
    """A follower was asked to write."""
