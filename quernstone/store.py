"""Small JSON state files: read whole, replaced atomically; a missing or broken file is empty, and a broken one is set aside."""

from __future__ import annotations

import json
import logging
import os
import tempfile
import threading
import time
from pathlib import Path
from typing import Any

log = logging.getLogger("quernstone")


class State:
    def __init__(self, path: Path):
        self.path, self.lock = path, threading.RLock()
        path.parent.mkdir(parents=True, exist_ok=True)

    def read(self) -> dict[str, Any]:
        try:
            found = json.loads(self.path.read_text())
        except FileNotFoundError:
            return {}
        except ValueError:
            found = None
        if isinstance(found, dict):
            return found
        log.error("state file %s is broken and counts as empty", self.path)
        return {}

    def _broken(self) -> bool:
        try:
            return not isinstance(json.loads(self.path.read_text()), dict)
        except FileNotFoundError:
            return False
        except ValueError:
            return True

    def write(self, content: dict[str, Any]) -> None:
        if self._broken():
            os.replace(self.path, self.path.with_name(f"{self.path.name}.broken-{time.time_ns()}"))
        handle, name = tempfile.mkstemp(dir=self.path.parent, prefix=self.path.name)
        with os.fdopen(handle, "w") as file:
            json.dump(content, file)
        os.replace(name, self.path)
