"""Splitting text into the pre-tokens of a public tokenizer, and counting or encoding each distinct one once.

Latin text is split by one regular expression whose character classes are
those of the tokenizer's pattern; any other text is split by the tokenizer
itself. Both give the same pieces.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

LAST_LATIN = 0x17F
LATIN = re.compile(rf"[\x00-\u{LAST_LATIN:04x}]*\Z")
#: Latin without the four separators, which are white space to ``str.split`` but not to the tokenizers.
PLAIN = re.compile(rf"[\x00-\x1b\x20-\u{LAST_LATIN:04x}]*\Z")


def _class(test) -> str:
    return "".join(f"\\u{c:04x}" for c in range(LAST_LATIN + 1) if test(c))


LETTERS = _class(lambda c: unicodedata.category(chr(c))[0] == "L")
NUMBERS = _class(lambda c: unicodedata.category(chr(c))[0] == "N")
SPACE = _class(lambda c: c in (0x20, 0x85, 0xA0) or 0x09 <= c <= 0x0D)

#: The two public split patterns, over Latin characters.
BYTE_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the folder is the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def byte_pretokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a byte-level tokenizer; a special string is one of its own, as the library's default has it."""
    for special in specials(path):
        if special in text:
            parts = text.split(special)
            out = byte_pretokens(parts[0], path)
            for part in parts[1:]:
                out.append(special)
                out += byte_pretokens(part, path)
            return out
    if LATIN.match(text):
        return BYTE_PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def word_pretokens(text: str, path: str) -> list[str] | None:
    """The pre-tokens of the lower-casing word tokenizer; None where only the tokenizer itself can tell."""
    if not LATIN.match(text) or "İ" in text or any(s in text for s in specials(path)):
        return None
    return WORD_PATTERN.findall(text.lower())


def word_runs(text: str, path: str) -> list[str] | None:
    """Runs of whole pre-tokens of the lower-casing word tokenizer, mostly the words between white space; None as above."""
    if not PLAIN.match(text) or "İ" in text or any(s in text for s in specials(path)):
        return word_pretokens(text, path)
    return text.lower().split()
