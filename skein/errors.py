"""What whole calls raise. A row that fails is no error: its columns are null, and `error` says why."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class StorageError(EngineError):
    """A table of the store cannot be read or written."""


class IngestionError(EngineError):
    """A batch of documents holds nothing to index."""


class ValidationError(EngineError):
    """A question or parameter is out of its bounds."""


class UnsupportedFileTypeError(IngestionError):
    """No loader takes files of this kind."""

    def __init__(self, kind: str, known: tuple[str, ...] = ("pdf", "txt", "md")) -> None:
        super().__init__(f"no loader for {kind or 'files without an extension'}; there are loaders for {', '.join(known)}")
        self.kind = kind
