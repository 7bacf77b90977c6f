"""Splitting of texts into the pieces within which byte-level merges work."""

from __future__ import annotations

import re

import numpy as np
import regex

# Code points up to U+027F by class. All others go to the general pattern.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɿ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
#: The largest first byte of a character up to U+027F in UTF-8.
_LATIN_LEAD = 0xC9

#: public_tokenizers.PATTERN for texts of characters up to U+027F. Letters come first as
#: the most frequent; the alternatives exclude each other but for those of an apostrophe.
LATIN = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_general: dict[str, regex.Pattern] = {}


def splitter(pattern: str, latin: bool = True):
    """A function from texts and their UTF-8 bytes to the lists of their pieces.

    The narrower pattern is only used for ``public_tokenizers.PATTERN``, which it equals there.
    """
    if pattern not in _general:
        _general[pattern] = regex.compile(pattern)
    general = _general[pattern].findall

    def run(texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list[str]]:
        if not latin or not len(data):
            return [general(t) for t in texts]
        filled = np.flatnonzero(np.diff(offsets))
        wide = np.zeros(len(texts), bool)
        wide[filled] = np.maximum.reduceat(data, offsets[filled]) > _LATIN_LEAD
        find = LATIN.findall
        return [general(t) if w else find(t) for t, w in zip(texts, wide.tolist(), strict=True)]

    return run


class Recent(dict):
    """Values of pieces seen lately: all of the last ``most`` or more, at most twice as many, and the current batch."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, pieces: set[str]) -> list[str]:
        """Pieces that must be computed; those of the older half move to the newer one."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        out, older = [], self.older
        for p in pieces:
            if p not in self:
                if p in older:
                    self[p] = older[p]
                else:
                    out.append(p)
        return out
