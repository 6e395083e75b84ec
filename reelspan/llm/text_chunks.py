"""Cutting text where a byte-level BPE may be cut, with bounded memos of what a cut gives.

The public pre-tokeniser never lets a match run over a single space between two
non-space characters: the space opens the next match. So a text with no other
white space beside a space falls apart at its spaces, and each part is encoded
alike wherever it stands. Other texts are cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space beside a space, or at either end: only the pattern can cut there.
UNSAFE = re.compile(r" \s|\s |\A\s|\s\Z")
#: White space other than the space and the line feed.
RARE_SPACE = re.compile(r"[^\S \n]")
#: Longer parts are encoded anew each time and not kept.
KEPT_CHARS = 48


def unsafe(text: str) -> bool:
    """Whether UNSAFE finds anything; plain searches answer for nearly all texts."""
    if "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace():
        return True
    return RARE_SPACE.search(text) is not None and UNSAFE.search(text) is not None


class ChunkMemo:
    """Texts to lists of encoded parts; ``encode`` maps a list of strings to their codes.

    ``split`` cuts a text into matches of the pre-tokeniser's pattern. At most
    ``cap`` parts are kept; when more come, the memo starts afresh.
    """

    def __init__(self, encode: Callable[[list[str]], list], split: Callable[[str], list[str]], cap: int = 400_000):
        self.encode, self.split, self.cap = encode, split, cap
        self.parts: dict[str, object] = {}

    def batch(self, texts: list[str]) -> list[list]:
        """For each text, the codes of its parts in order."""
        parts = self.parts
        if len(parts) > self.cap:
            parts.clear()
        cut: list[list[str]] = []
        wanted: set[str] = set()
        for text in texts:
            if not text:
                pieces = []
            elif unsafe(text):
                pieces = ["\0" + p for p in self.split(text)]
            else:
                # A part stands for itself and the space before it. "\0" marks a part with
                # no space before it: the first one, and matches of the pattern.
                pieces = text.split(" ")
                pieces[0] = "\0" + pieces[0]
            wanted.update(pieces)
            cut.append(pieces)
        missing = [p for p in wanted if p not in parts]
        if missing:
            parts.update(zip(missing, self.encode([p[1:] if p[:1] == "\0" else " " + p for p in missing])))
        out = [list(map(parts.__getitem__, pieces)) for pieces in cut]
        for p in missing:
            if len(p) > KEPT_CHARS:
                del parts[p]
        return out
