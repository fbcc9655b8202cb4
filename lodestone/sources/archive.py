"""Keeping a run's outputs under a tag."""

from __future__ import annotations

import shutil
from pathlib import Path


def archive(paths, tag: str, root: str = "submissions") -> int:
    """Copies both outputs and the run info to root/tag; 1 if that exists or there is nothing to keep."""
    to = Path(root) / tag
    found = [p for p in (Path(paths.matching), Path(paths.candidates)) if p.exists()]
    if to.exists() or len(found) < 2:
        return 1
    to.mkdir(parents=True)
    for p in [*found, *Path(paths.output).glob("run_info_*.json")]:
        shutil.copy2(p, to / p.name)
    return 0
