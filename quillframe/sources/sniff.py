"""Guesses about delimited text from its first lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

SEPARATORS = [",", ";", "|", "\t", " "]
COMMENTS = ("#", "@")
_NUMBER = re.compile(r"^\s*\$?[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?\s*$")
_EOL = re.compile("\r\n|[\n\r\x0b\x0c]")


@dataclass(frozen=True)
class Setup:
    separator: str
    header: bool
    names: list[str]
    quote: str | None  # ' if the sample uses it


def is_number(s: str) -> bool:
    return bool(_NUMBER.match(s))


def lines_of(text: str) -> list[str]:
    """Lines that aren't blank, at any of LF, CR, CRLF, VT and FF."""
    return [x for x in _EOL.split(text) if x.strip()]


def tokenize(line: str, sep: str) -> list[str]:
    """Fields of a line; ' and " quote, a doubled quote within is one; runs of spaces are one separator if it is the space."""
    out, field, i, n = [], [], 0, len(line)
    if sep == " ":
        line = line.strip(" ")
        n = len(line)
    fresh, quoted = True, False
    while i <= n:
        c = line[i] if i < n else None
        if c is None or c == sep:
            text = "".join(field)
            out.append(text if quoted else text.strip())
            field, fresh, quoted = [], True, False
            if sep == " ":
                while i + 1 < n and line[i + 1] == " ":
                    i += 1
        elif fresh and c in "'\"" and _closes(line, i, sep):
            q, i, quoted, fresh = c, i + 1, True, False
            field = []
            while i < n and not (line[i] == q and (i + 1 >= n or line[i + 1] != q)):
                i += 1 if line[i] == q else 0
                field.append(line[i])
                i += 1
            while i + 1 < n and line[i + 1] != sep:
                i += 1
        else:
            fresh = fresh and c in " \t"
            field.append(c)
        i += 1
    return out


def _closes(line: str, start: int, sep: str) -> bool:
    """Whether the quote at start has an end that a separator or the line's end follows."""
    q, i = line[start], start + 1
    while (i := line.find(q, i)) >= 0:
        if i + 1 < len(line) and line[i + 1] == q:
            i += 2
            continue
        rest = line[i + 1 :]
        return sep == " " or not rest.strip() or rest.lstrip(" ").startswith(sep) or (sep == "\t" and rest.startswith(sep))
    return False


def separator(lines: list[str]) -> str:
    """The first candidate that the first two lines hold equally often, and cut into equally many fields; else the space."""
    two = lines[:2]
    for s in SEPARATORS:
        counts = [x.strip().count(s) for x in two]
        if counts and counts[0] and all(c == counts[0] for c in counts) and len({len(tokenize(x, s)) for x in two}) == 1:
            return s
    for s in SEPARATORS:
        if two and len({len(tokenize(x, s)) for x in two}) == 1 and len(tokenize(two[0], s)) > 1:
            return s
    return " "


def sniff(text: str, header: bool | None = None, sep: str | None = None) -> Setup:
    """Separator, header and names; the first line is a header if it has no number and the second has one."""
    lines = [x for x in lines_of(text) if not x.startswith(COMMENTS)]
    if not lines:
        return Setup(sep or ",", False, [], None)
    sep = sep or separator(lines)
    first = tokenize(lines[0], sep)
    second = tokenize(lines[1], sep) if len(lines) > 1 else []
    guess = not any(map(is_number, first)) and any(map(is_number, second))
    has = guess if header is None else header
    width = max(len(first), len(second)) if not has else len(first)
    names = [n or str(k) for k, n in enumerate(first)] if has else [str(k) for k in range(width)]
    seen: dict[str, int] = {}
    for k, n in enumerate(names):
        if n in seen:
            names[k] = f"{n}_{k}"
        seen[n] = k
    single = any(re.search(rf"(^|{re.escape(sep)})\s*'", x) for x in lines)
    return Setup(sep, has, names, "'" if single else None)
