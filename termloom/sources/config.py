"""Small files that a run is set up with: prompts and label maps."""

from __future__ import annotations

import json
from pathlib import Path

# The labels of a tagger that has no label map.
LABELS = {0: "O", 1: "B-PHENO", 2: "I-PHENO", 3: "E-PHENO", 4: "S-PHENO"}


def load_prompt(path: str) -> str:
    """The text of a prompt; a file that is not there is an error."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"no prompt at {path}")
    return p.read_text(encoding="utf-8")


def load_labels(path: str | None) -> dict[int, str]:
    """Labels by number, from the object ``id2label`` of a JSON file; the usual ones where file or object are missing or empty."""
    if path is None or not Path(path).is_file():
        return dict(LABELS)
    found = json.loads(Path(path).read_text(encoding="utf-8")).get("id2label")
    return {int(k): v for k, v in found.items()} if isinstance(found, dict) and found else dict(LABELS)
