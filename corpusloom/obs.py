"""Events as JSON lines on stderr: names, counts and durations, never the data or a query's text."""

from __future__ import annotations

import contextlib
import json
import sys
import time
import uuid

RUN_ID = uuid.uuid4().hex
#: Values of these types may be told; anything else is told as its type.
PLAIN = (int, float, bool, type(None))
#: Texts that may be told, by field.
NAMES = {"repo", "outcome", "error", "kind", "command", "operator", "reason"}


def event(name: str, **fields) -> None:
    told = {k: v if isinstance(v, PLAIN) or (isinstance(v, str) and k in NAMES) else type(v).__name__ for k, v in fields.items()}
    print(json.dumps({"@timestamp": time.time(), "event": name, "run_id": RUN_ID, **told}, sort_keys=True), file=sys.stderr)


@contextlib.contextmanager
def timed(name: str, **fields):
    """Tells how long the block took and whether it ended well; what the block puts into the dict is told too."""
    began, more = time.monotonic(), dict(fields)
    try:
        yield more
    except Exception as e:
        event(name, **more, outcome="error", error=type(e).__name__, duration_ms=round(1000 * (time.monotonic() - began)))
        raise
    event(name, **more, outcome="ok", duration_ms=round(1000 * (time.monotonic() - began)))
