"""Log lines whose values stand on lines of their own."""

from __future__ import annotations

import logging


class Multiline(logging.Formatter):
    """``LEVEL message``, then an indented ``name: value`` for each field of ``extra={"fields": {...}}``; long values are cut in the middle."""

    def __init__(self, width: int = 100):
        super().__init__("%(asctime)s %(levelname)-7s %(message)s", "%H:%M:%S")
        self.width = width

    def format(self, record: logging.LogRecord) -> str:
        lines = [super().format(record)]
        fields = getattr(record, "fields", {})
        pad = max(map(len, fields), default=0)
        for name, value in fields.items():
            said = str(value)
            if len(said) > self.width:
                half = (self.width - 3) // 2
                said = f"{said[:half]}...{said[-half:]}"
            lines.append(f"    {name:<{pad}}: {said}")
        return "\n".join(lines)
