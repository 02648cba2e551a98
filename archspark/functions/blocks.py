"""Where blocks of code end, from running depths and not from scans line by line.

A file is turned once into arrays: for braces the positions of the characters and the
depth after each, for indents the depth of each line with code, for ``end`` words the
depth after each line. The end of a block that begins on a line is then the first place
at or after it where the depth is again what it was before the line. Searches end
after ``values.BLOCK_LINES`` lines; without an end the block has ``BLOCK_FALLBACK`` more lines.
"""

from __future__ import annotations

import re

import numpy as np

from .. import values as V


def _fallback(start: int, lines: int) -> int:
    return min(start + V.BLOCK_FALLBACK, lines - 1)


class Braces:
    """Ends of ``{`` ``}`` blocks; quotes: braces inside quotes of a line don't count."""

    def __init__(self, content: str, quotes: bool = False):
        c = np.frombuffer(content.encode("utf-32-le", "surrogatepass"), np.uint32)
        feeds = np.flatnonzero(c == 10)
        self.lines = len(feeds) + 1
        at = np.flatnonzero((c == 123) | (c == 125))
        line = np.searchsorted(feeds, at)
        if quotes:
            mark = (c == 34) | (c == 39) | (c == 96)
            mark[1:] &= c[:-1] != 92
            total = np.cumsum(mark)
            begins = np.concatenate([[0], feeds + 1])
            before = np.concatenate([[0], total])[begins[line]]
            outside = (total[at] - before) % 2 == 0
            at, line = at[outside], line[outside]
        self.line = line
        self.closes = c[at] == 125
        self.depth = np.cumsum(np.where(self.closes, -1, 1)) if len(at) else np.zeros(0, np.int64)

    def end(self, start: int) -> int:
        a, b = np.searchsorted(self.line, [start, start + V.BLOCK_LINES])
        base = int(self.depth[a - 1]) if a else 0
        hit = np.flatnonzero(self.closes[a:b] & (self.depth[a:b] == base))
        return int(self.line[a + hit[0]]) if len(hit) else _fallback(start, self.lines)


class Indents:
    """Ends of indented blocks: the line before the next code that is not deeper."""

    def __init__(self, lines: list[str]):
        self.lines = len(lines)
        self.depth = np.array([len(x) - len(x.lstrip()) for x in lines], np.int64)
        self.code = np.array([bool(s := x.strip()) and not s.startswith("#") for x in lines], bool)

    def end(self, start: int) -> int:
        stop = min(start + V.BLOCK_LINES, self.lines)
        hit = np.flatnonzero(self.code[start + 1 : stop] & (self.depth[start + 1 : stop] <= self.depth[start]))
        return start + int(hit[0]) if len(hit) else _fallback(start, self.lines)


class Ends:
    """Ends of blocks that the word ``end`` closes."""

    _opens = re.compile(V.RUBY_BLOCK)

    def __init__(self, lines: list[str]):
        self.lines = len(lines)
        bare = [x.strip() for x in lines]
        opens = np.array([bool(self._opens.match(x)) or s.endswith(" do") for x, s in zip(lines, bare, strict=True)], np.int64)
        self.closes = np.array([s == "end" or s.startswith(("end ", "end;")) for s in bare], bool)
        self.depth = np.cumsum(opens - self.closes)

    def end(self, start: int) -> int:
        stop = min(start + V.BLOCK_LINES, self.lines)
        base = int(self.depth[start - 1]) if start else 0
        hit = np.flatnonzero(self.closes[start:stop] & (self.depth[start:stop] == base))
        return start + int(hit[0]) if len(hit) else _fallback(start, self.lines)


def brace_body(content: str, start: int) -> str:
    """From the first ``{`` at or after start to the ``}`` that closes it, or to the end of the text."""
    first = content.find("{", start)
    if first < 0:
        return ""
    depth = 0
    for m in re.finditer(r"[{}]", content[first:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return content[first : first + m.end()]
    return content[first:]
