"""Errors of the engine, one class for each status."""

from __future__ import annotations

#: Status codes and their names.
STATUS = {
    "ok": 0, "not_found": 1, "out_of_memory": 2, "invalid_argument": 3, "corrupted_data": 4, "io_error": 5,
    "not_supported": 6, "already_exists": 7, "not_visible": 8, "fatal": 9, "no_space": 10,
}


class EngineError(RuntimeError):
    """Base of all; ``code`` names the status and ``status`` is its number."""

    code = "fatal"

    @property
    def status(self) -> int:
        return STATUS[self.code]


class NotFound(EngineError):
    code = "not_found"


class OutOfMemory(EngineError):
    code = "out_of_memory"


class InvalidArgument(EngineError):
    code = "invalid_argument"


class Corruption(EngineError):
    code = "corrupted_data"


class IoError(EngineError):
    code = "io_error"


class NotSupported(EngineError):
    code = "not_supported"


class AlreadyExists(EngineError):
    code = "already_exists"


class Conflict(EngineError):
    """Another transaction that committed first changed the same rows: those this one saw are visible no more."""

    code = "not_visible"


class Fatal(EngineError):
    code = "fatal"


class NoSpace(EngineError):
    code = "no_space"


#: What a failure of Spark or of the file system says, and what it then is; the first that fits.
_SAID = (
    ("No space left on device", NoSpace), ("DSQuotaExceeded", NoSpace), ("OutOfMemoryError", OutOfMemory),
    ("is not a Parquet file", Corruption), ("CANNOT_READ_FILE_FOOTER", Corruption),
    ("FileNotFoundException", IoError), ("PATH_NOT_FOUND", IoError), ("FILE_NOT_EXIST", IoError), ("IOException", IoError),
)


def engine_error(failure: Exception) -> EngineError:
    """The engine's error for a failure that Spark or the operating system reported."""
    text = f"{type(failure).__name__}: {failure}"
    kind = next((k for said, k in _SAID if said in text), IoError if isinstance(failure, OSError) else Fatal)
    return kind(text.splitlines()[0])
