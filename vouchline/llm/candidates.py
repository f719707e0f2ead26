"""Raw candidates read as the reference reads them: JSON text to question and answer, questions to words."""

from __future__ import annotations

import json
import re
import unicodedata

cut = re.compile(r"\w+(?:\.\d+)?").findall


def as_object(raw: str | None) -> dict | None:
    """The JSON object that a raw text is, else None."""
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def folded(text: str) -> str:
    """Compatibility forms unified, case folded, white space collapsed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.casefold().split())


def words(text: str) -> list[str]:
    return cut(folded(text))
