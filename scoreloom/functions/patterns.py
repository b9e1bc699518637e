"""Patterns built from plain word lists.

In a word list a blank stands for white space, ``-`` for a blank, a hyphen or nothing, ``.`` for a full stop or nothing, and a ``*`` at the
end for any further letters. Everything else stands for itself, in either case.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
PLACEHOLDERS = {" ": r"\s+", "-": r"[\s-]?", ".": r"\.?", "*": rf"{WORD}*"}
BETWEEN = r"\s*(?:[:–-]|of\b)?\s*"  # what may stand between a name and its number


def plain(word: str) -> str:
    """The pattern of one entry of a word list, its own edges left open."""
    return "".join(PLACEHOLDERS.get(c, re.escape(c) if c.isascii() and not c.isalnum() else c) for c in word)


def any_of(words: list[str]) -> str:
    return "(?i:" + "|".join(plain(w) for w in words) + ")"


def whole(words: list[str]) -> str:
    """Any of the words, not as a part of a longer one."""
    return f"(?<!{WORD}){any_of(words)}(?!{WORD})"


def number(digits: str, decimals: bool = False) -> str:
    return rf"(\d{{{digits}}}{r'(?:\.\d+)?' if decimals else ''})"


def before(words: list[str], digits: str, decimals: bool = False) -> str:
    """A number, group 1, right before one of the words."""
    return rf"(?<![\d.]){number(digits, decimals)}\s*\+?\s*{any_of(words)}(?!{WORD})"


def after(words: list[str], digits: str, decimals: bool = False) -> str:
    """A number, group 1, after one of the words."""
    return rf"(?<!{WORD}){any_of(words)}{BETWEEN}{number(digits, decimals)}(?!\d)"
