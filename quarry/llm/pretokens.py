"""The split of a text before any merges, remembered for stretches that recur.

No match of the splitting pattern crosses from a non-space into a space, so a text is first cut into stretches (one space
at most and what follows up to the next white space, or a run of white space) whose own splits are found once.
"""

from __future__ import annotations

import re

import regex

#: The characters that Unicode calls white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def stretches(text: str) -> list[str]:
    """STRETCH.findall(text), by plain splits where nothing but one space or one line end stands between words."""
    if text and "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
    return STRETCH.findall(text)


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token's bytes in base 64 and its rank."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Memory(dict):
    """A dict that is emptied when a bound is reached: it only saves time."""

    def __init__(self, bound: int) -> None:
        super().__init__()
        self.bound = bound

    def room(self) -> None:
        if len(self) >= self.bound:
            self.clear()


class Splitter:
    """pattern: a splitting pattern under which white space joins a following word as one space at most, and letters with it are one pre-token."""

    def __init__(self, pattern: str) -> None:
        self.find = regex.compile(pattern).findall

    def __call__(self, stretch: str) -> list[str]:
        letters = stretch[1:] if stretch[0] == " " else stretch
        return [stretch] if letters.isalpha() and letters.isascii() else self.find(stretch)
