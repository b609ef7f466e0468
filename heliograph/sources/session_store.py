"""A user's selection between sessions: a small JSON file, replaced as a whole."""

from __future__ import annotations

import json
import os
import time


class SelectionStore:
    """Saves at most once in `pause` seconds unless told to; a damaged or missing file is an empty selection."""

    def __init__(self, path: str, pause: float = 1.0):
        self.path, self.pause, self._saved, self._owed = path, pause, 0.0, False
        self.selected: set[int] = self._load()

    def _load(self) -> set[int]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return {int(x) for x in json.load(f)["selected"]}
        except (OSError, ValueError, KeyError, TypeError):
            return set()

    def mutate(self, change) -> None:
        """change(set) alters the selection; it is saved when the pause is over, or by flush()."""
        change(self.selected)
        self._owed = True
        if time.monotonic() - self._saved >= self.pause:
            self.flush()

    def flush(self) -> None:
        if self._owed:
            temporary = f"{self.path}.{os.getpid()}.tmp"
            with open(temporary, "w", encoding="utf-8") as f:
                json.dump({"selected": sorted(self.selected)}, f)
            os.replace(temporary, self.path)
            self._saved, self._owed = time.monotonic(), False
