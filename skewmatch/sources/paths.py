"""Fresh output folders under a base folder."""

from __future__ import annotations

import uuid


def new_output_path(base: str, name: str = "matches") -> str:
    """A fresh folder name under ``base`` (the shared checkpoint folder)."""
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
