"""Errors of the engine, under one root."""


class EngineError(Exception):
    pass


class LayoutError(EngineError):
    """A layout's fields, offsets or masks do not fit together."""


class FieldError(EngineError):
    """A value does not fit its field, or a field does not belong to the layout."""


class StaleHandleError(EngineError):
    """The handle's record was released, or it belongs to another store."""


class VersionOverflowError(EngineError):
    """A record would pass the highest version."""


class ClosedError(EngineError):
    """The store or worker was closed."""


class TransactionError(EngineError):
    """Nested or asynchronous transactions, or access while one runs."""


class BackpressureError(EngineError):
    """A bounded buffer would be exceeded; nothing of the input was taken."""

    def __init__(self, message: str, pending: int = 0, most: int = 0, size: int = 0) -> None:
        super().__init__(message)
        self.pending, self.most, self.size = pending, most, size


class IntegrityError(EngineError):
    """A journal on disk is damaged; it stays failed."""


class CaptureFormatError(EngineError):
    """Bytes that are no valid capture batch."""
