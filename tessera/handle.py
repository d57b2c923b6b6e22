"""A plain handle on a database: text in, cells of text out, and a status instead of an exception.

For callers that bind the engine from other languages or only want to show results.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import EngineError
from .functions.types import rendered
from .session import Database, Executor


class Result:
    """Rows as text; what is out of range is None."""

    def __init__(self, names: list[str], rows: list[tuple]):
        self.names = names
        self.rows = rows

    @property
    def row_count(self) -> int:
        return len(self.rows)

    @property
    def column_count(self) -> int:
        return len(self.names)

    def column_name(self, column: int) -> str | None:
        return self.names[column] if 0 <= column < len(self.names) else None

    def value(self, row: int, column: int) -> str | None:
        """A cell as the shell shows it."""
        if not (0 <= row < len(self.rows) and 0 <= column < len(self.names)):
            return None
        return rendered(self.rows[row][column])


class Handle:
    """An open database.  Every call has a connection of its own, so a transaction can't span calls."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.db: Database | None = Database.open(path, spark)
        self.error_message = ""

    def execute(self, sql: str) -> tuple[int, Result | None]:
        """The status (0: done, else the error's number, with its text in ``error_message``) and the result."""
        if self.db is None:
            self.error_message = "the database is closed"
            return 3, None
        connection = self.db.connect()
        try:
            found = Result(*Executor(connection).table(sql))
        except EngineError as e:
            self.error_message = str(e)
            return e.status, None
        finally:
            if connection.work is not None:
                connection.rollback()
        self.error_message = ""
        return 0, found

    def close(self) -> None:
        if self.db is not None:
            self.db.close()
        self.db = None
