"""Errors that callers can tell apart."""


class EngineError(Exception):
    pass


class IncompatibleSchemaError(EngineError):
    def __init__(self, missing: list[str]):
        super().__init__(f"the table lacks {', '.join(missing)}")
        self.missing = missing


class IngestionError(EngineError):
    """Carries the report of what was done."""

    def __init__(self, message: str, report=None):
        super().__init__(message)
        self.report = report


class InsufficientContextError(EngineError):
    pass


class InvalidEmbeddingError(EngineError):
    pass


class BatchWindowError(EngineError):
    """A batch of a window failed: the others that had been started were finished and thrown away."""

    def __init__(self, failed: int, started: list[int], completed: list[int], discarded: list[int]):
        super().__init__(f"batch {failed} failed; {len(discarded)} others of its window were discarded")
        self.failed, self.started, self.completed, self.discarded = failed, started, completed, discarded

    def __reduce__(self):  # workers send it to the driver
        return type(self), (self.failed, self.started, self.completed, self.discarded)


class PdfExtractionError(EngineError):
    pass


class ProviderError(EngineError):
    pass


class RerankerError(EngineError):
    def __init__(self, message: str, timed_out: bool = False):
        super().__init__(message)
        self.timed_out = timed_out


class StreamingNotSupportedError(EngineError):
    pass
