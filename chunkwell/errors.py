"""The six kinds of failure.  The kind's name stands in the message, so it survives the trip through Spark's own errors."""


class EngineError(Exception):
    kind = "Error"

    def __init__(self, what: str):
        self.what = what
        super().__init__(f"{self.kind}: {what}")

    def __reduce__(self):
        return type(self), (self.what,)


class ParseError(EngineError):
    """Bytes that are not what the format asks for."""

    kind = "Parse"


class StoreError(EngineError):
    """A failure of the store that holds the file."""

    kind = "Store"


class UnsupportedError(EngineError):
    """A valid file that uses a feature which is not read here."""

    kind = "Unsupported"


class TypeMismatchError(EngineError):
    """A read that asks for another element type than the stored one."""

    kind = "TypeMismatch"


class InvalidSelectionError(EngineError):
    """A selection that does not fit the rank, or runs backwards."""

    kind = "InvalidSelection"


class CorruptError(EngineError):
    """Well-formed metadata that contradicts itself or the data."""

    kind = "Corrupt"
