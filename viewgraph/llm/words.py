"""Words of a text as the leak search counts them."""

from __future__ import annotations

import re

#: The ranges in which each character is a word.
SINGLE = "぀-ヿ㐀-鿿"
_WORD = re.compile(f"[{SINGLE}]|[^\\W_{SINGLE}]+")
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()}


def words_of(text: str | None) -> list[str]:
    """Lower case words: single characters of the ranges above, else longest runs of letters and digits."""
    if not text:
        return []
    text = text.lower()
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)
