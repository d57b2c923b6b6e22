"""Scheduled backups: a thread that calls ``tick``, which tests call with a time of their own."""

from __future__ import annotations

import re
import threading
import time

from ..session import Database
from ..sources.log import Files


class BackupSchedule:
    """Backups of a database every ``interval`` seconds to siblings ``backup_<ms>``; those older than ``retention`` go.

    Both numbers are those of ``SET BACKUP``; 0 switches off.
    """

    def __init__(self, db: Database):
        self.db = db
        self.folder = db.path.rsplit("/", 1)[0]
        self._last = int(time.time() * 1000)
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def tick(self, now_ms: int | None = None) -> str | None:
        """Take a backup if one is due, then drop expired ones; returns the new backup's folder."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        config = self.db.config()
        made = None
        if config["interval"] and now - self._last >= config["interval"] * 1000:
            made = f"{self.folder}/backup_{now}"
            self.db.backup(made)
            self._last = now
        if config["retention"]:
            files = Files(self.db.spark, self.folder)
            for name in files.names(self.folder):
                m = re.fullmatch(r"backup_(\d+)", name)
                if m and int(m[1]) < now - config["retention"] * 1000:
                    files.delete(f"{self.folder}/{name}")
        return made

    def start(self, every_s: float = 1.0) -> None:
        def run() -> None:
            while not self._stop.wait(every_s):
                self.tick()

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
