"""What the lexers share: the fault they raise, and merge-conflict markers."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager


class Fault(Exception):
    """The text is no valid file; ``args[0]`` names the kind: literal, delimiter, end, conflict, character or grammar."""


#: A line that version control leaves in a file it could not merge.
CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.MULTILINE)

CLOSES = {")": "(", "]": "[", "}": "{"}

#: Brackets nested deeper than this are a fault. It is the limit that Go's own parser states; no compiler of the other languages goes as deep.
NESTED = 100_000


@contextmanager
def deep() -> Iterator[None]:
    """Room for recursive descent as deep as the text is nested.

    Frames of calls from Python to Python lie on the heap, so only the interpreter's counter stands against it; it has no
    bearing on the verdict. A level takes about 3.5 kB, so NESTED levels stay within 350 MB.
    """
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(1 << 30)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)
