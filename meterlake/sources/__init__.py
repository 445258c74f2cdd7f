"""Readers of request logs: each turns the lines of one harness into records of one shape."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from meterlake.sources import claude as _claude
from meterlake.sources import codex as _codex
from meterlake.sources import cursor as _cursor
from meterlake.sources import pi as _pi
from meterlake.sources.claude import claude
from meterlake.sources.codex import codex
from meterlake.sources.cursor import cursor
from meterlake.sources.opencode import opencode
from meterlake.sources.pi import pi

#: A reader for each kind of log, from lines (file, ordinal, text) to records (records.RECORD); opencode reads messages.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude-code": claude, "codex": codex, "cursor": cursor, "opencode": opencode, "pi": pi}

Step = Callable[[DataFrame], DataFrame]


class Steps(NamedTuple):
    """A reader in three steps, for logs that grow.

    parsed: what each line says, line by line, without the text. records: the records of parsed lines. context: the few parsed
    lines of each file that records of later lines depend on; with them before the new lines, records gives for those what a
    read of the whole file gives.
    """

    parsed: Step
    records: Step
    context: Step
    version: str


STEPS = {
    "claude-code": Steps(_claude.parsed, _claude.records, _claude.context, "claude-2"),
    "codex": Steps(_codex.parsed, _codex.records, _codex.context, "codex-2"),
    "cursor": Steps(_cursor.parsed, _cursor.records, _cursor.context, "cursor-2"),
    "pi": Steps(_pi.parsed, _pi.records, _pi.context, "pi-2"),
}
