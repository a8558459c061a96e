"""Write-ahead log of a table: one file of JSON for each mutation, in order of its number."""

from __future__ import annotations

import json
from collections.abc import Iterator

from vectorframe.sources.storage import filesystem, listed, read_text, replace_text

KINDS = ("INSERT", "UPSERT", "DELETE")


class Log:
    def __init__(self, uri: str, enabled: bool = True):
        self.uri, self.enabled = uri, enabled

    def append(self, number: int, kind: str, payload: object) -> None:
        if self.enabled:
            replace_text(f"{self.uri}/{number:020d}.json", json.dumps({"id": number, "type": kind, "payload": payload}) + "\n")

    def after(self, number: int) -> Iterator[tuple[int, str, object]]:
        """Entries above ``number``, in order. Two forms of deletion are read: a list of keys,
        and an object of keys and filter."""
        for name in listed(self.uri):
            if name.endswith(".json") and int(name[:-5]) > number:
                entry = json.loads(read_text(f"{self.uri}/{name}"))
                payload = entry["payload"]
                if entry["type"] == "DELETE" and isinstance(payload, list):
                    payload = {"primaryKeys": payload, "filter": ""}
                yield entry["id"], entry["type"], payload

    def trim(self, number: int) -> None:
        """Drop entries that a snapshot holds."""
        fs, path = filesystem(self.uri)
        for name in listed(self.uri):
            if name.endswith(".json") and int(name[:-5]) <= number:
                fs.delete_file(f"{path}/{name}")
