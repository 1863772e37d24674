"""Where a workspace is, and its settings."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from pathlib import Path

#: Folder that marks a workspace and holds its snapshots; variable that names its parent.
MARKER, ROOT = ".gleanworks", "GLEANWORKS_ROOT"
_ENV = """# Settings of this workspace; variables that are already set come first.
# LLM_API_KEY=
# LLM_BASE_URL=
# LLM_MODEL=
# EMBEDDING_PROVIDER=hash
# EMBEDDING_API_KEY=
# EMBEDDING_BASE_URL=
# EMBEDDING_MODEL=
"""


def find(start: Path | None = None) -> Path:
    """The workspace of a folder: what ROOT says, else the nearest folder upwards with
    a marker, else one that would be made here."""
    if named := os.environ.get(ROOT):
        return Path(named).expanduser().resolve() / MARKER
    here = (start or Path.cwd()).resolve()
    return next((p / MARKER for p in (here, *here.parents) if (p / MARKER).is_dir()), here / MARKER)


def create(path: Path, version: str) -> None:
    """The folder with its description, and a file of settings beside it; what is there stays."""
    path.mkdir(parents=True, exist_ok=True)
    about = path / "workspace.json"
    if not about.exists():
        about.write_text(json.dumps({"schema_version": 1, "created_at": datetime.now(timezone.utc).isoformat(), "version": version}) + "\n", encoding="utf-8")
    settings = path.parent / ".env"
    if path.name == MARKER and not settings.exists():
        settings.write_text(_ENV, encoding="utf-8")


def load_settings(path: Path) -> list[str]:
    """Sets variables of the file of settings beside a workspace that aren't set yet;
    returns their names."""
    settings = path.parent / ".env"
    if path.name != MARKER or not settings.exists():
        return []
    made = []
    for line in settings.read_text(encoding="utf-8").splitlines():
        name, is_one, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if is_one and name.isidentifier() and name not in os.environ:
            os.environ[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
            made.append(name)
    return made
