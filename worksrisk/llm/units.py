"""Cut texts at spaces where byte-level pre-tokenisers always cut, and remember what was seen.

The pattern of byte-level BPE takes a space into the match that follows it, so a cut before a
single space changes nothing, except inside a run of white space, whose last space alone
belongs to what follows. A cut before a space is therefore safe if the character before it
is not white space, or the one after it is not.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_BEFORE_BLANK = re.compile(r" (?=\s|\Z)")
REMEMBER = 300_000   # entries, in two generations
LONGEST = 200        # characters of a key that is worth remembering


class Remembered(dict):
    """A function's results by argument, a bounded number of them.

    When half of the entries are new, the older half is dropped; what is asked for again
    moves to the newer half first. Long arguments are not kept.
    """

    def __init__(self, function: Callable, entries: int = REMEMBER):
        super().__init__()
        self.function, self.half, self.older = function, max(1, entries // 2), {}

    def keep(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, items: dict) -> None:
        """Several at once; the long ones are left out."""
        if len(self) + len(items) > self.half:
            self.older = dict(self)
            self.clear()
        self.update((k, v) for k, v in items.items() if len(k) <= LONGEST)

    def found(self, keys: set) -> tuple[dict, list]:
        """What is remembered of these keys, and the keys that are not."""
        now, old, known, again, unseen = self.get, self.older.get, {}, {}, []
        for key in keys:
            value = now(key)
            if value is None:
                value = old(key)
                if value is None:
                    unseen.append(key)
                    continue
                again[key] = value
            known[key] = value
        self.keep_all(again)
        return known, unseen

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= LONGEST:
            self.keep(key, value)
        return value


_kept: dict = {}


def kept(key, make: Callable):
    """The object that this Python worker keeps between tasks; another key's replaces it.

    So a worker that serves one operator after the other holds the tables of one at a time.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def cuts_are_safe(text: str) -> bool:
    """Whether the text may be cut before every space."""
    return not any(m.start() and text[m.start() - 1].isspace()
                   for m in _BEFORE_BLANK.finditer(text))


def units(text: str) -> list[str]:
    """Pieces whose encodings, one after the other, are the encoding of the text."""
    parts = text.split(" ")
    pieces = [" " + p for p in parts]
    pieces[0] = parts[0]
    if not pieces[0]:
        del pieces[0]
    if cuts_are_safe(text):
        return pieces
    joined = pieces[:1]
    for piece in pieces[1:]:
        # unsafe: white space before this space, and white space (or the end) after it
        if joined[-1][-1].isspace() and (len(piece) == 1 or piece[1].isspace()):
            joined[-1] += piece
        else:
            joined.append(piece)
    return joined
