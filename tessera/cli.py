"""A small shell: statements to their semicolon, and ``.tables``, ``.schema NAME``, ``.help``, ``.exit``."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from .errors import EngineError
from .functions.types import rendered
from .session import Database, Executor

HELP = """Statements end with ;
.tables          names of the tables
.schema NAME     columns of a table
.help            this text
.exit            leave (also .quit, exit, quit)"""


def boxed(rows: list[dict]) -> str:
    """Rows as a table with a line that counts them."""
    if not rows:
        return "(0 rows)"
    names = list(rows[0])
    cells = [[rendered(r[n]) for n in names] for r in rows]
    width = [max(len(n), *(len(c[k]) for c in cells)) for k, n in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda xs: "|" + "|".join(f" {x:<{w}} " for x, w in zip(xs, width, strict=True)) + "|"
    count = f"({len(rows)} row{'s' * (len(rows) != 1)})"
    return "\n".join([rule, line(names), rule, *map(line, cells), rule, count])


class Shell:
    def __init__(self, db: Database):
        self.db = db
        self.executor = Executor(db)

    def command(self, text: str) -> str | None:
        """The answer to a dot command; None to leave."""
        word, _, rest = text.partition(" ")
        if word in (".exit", ".quit", "exit", "quit"):
            return None
        if word == ".tables":
            return "\n".join(self.db.tables()) or "(no tables)"
        if word == ".schema":
            return "\n".join(f"{n} {k}" for n, k in self.db.schema(rest.strip()))
        return HELP if word in (".help", "help") else f"unknown command {word}; .help lists them"

    def run(self, lines: Iterable[str], out=None) -> None:
        out = out or sys.stdout
        held = ""
        for raw in lines:
            text = raw.strip()
            if not held and (text.startswith(".") or text in ("exit", "quit", "help")):
                try:
                    answer = self.command(text)
                except EngineError as e:
                    answer = f"error: {e}"
                if answer is None:
                    return
                print(answer, file=out)
                continue
            held += raw if raw.endswith("\n") else raw + "\n"
            if text.endswith(";"):
                statement, held = held, ""
                try:
                    print(boxed(self.executor.execute(statement)), file=out)
                except EngineError as e:
                    print(f"error: {e}", file=out)


def main() -> None:
    path = sys.argv[1] if len(sys.argv) > 1 else "./tessera-db"
    Shell(Database.open(path)).run(sys.stdin)


if __name__ == "__main__":
    main()
