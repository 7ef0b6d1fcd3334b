"""Shell globs as Java regular expressions, compiled once on the driver.

The dialect is that of POSIX ``fnmatch`` without flags: ``*`` and ``?`` also match ``/`` and a
leading dot, ``[...]`` takes ranges, classes and ``!`` or ``^`` negation, a backslash escapes,
an unclosed ``[`` is a plain character. A pattern matches if it does so exactly or after
lower-casing ASCII letters on both sides. The empty pattern never matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "(?!)"

# ASCII members of the POSIX character classes.
_CLASSES = {
    "alpha": [(65, 90), (97, 122)],
    "digit": [(48, 57)],
    "alnum": [(48, 57), (65, 90), (97, 122)],
    "upper": [(65, 90)],
    "lower": [(97, 122)],
    "space": [(9, 13), (32, 32)],
    "blank": [(9, 9), (32, 32)],
    "punct": [(33, 47), (58, 64), (91, 96), (123, 126)],
    "print": [(32, 126)],
    "graph": [(33, 126)],
    "cntrl": [(0, 31), (127, 127)],
    "xdigit": [(48, 57), (65, 70), (97, 102)],
}


def _lower(ch: str) -> str:
    return ch.lower() if "A" <= ch <= "Z" else ch


def _literal(ch: str, fold: bool) -> str:
    if ch.isascii() and ch.isalpha():
        return f"[{ch.lower()}{ch.upper()}]" if fold else ch
    return _code(ord(ch))


def _code(point: int) -> str:
    """One character in a form that Java and Python regexes both read."""
    ch = chr(point)
    return rf"\x{point:02X}" if ch.isascii() and not ch.isalnum() else ch


def _unfold(lo: int, hi: int) -> list[tuple[int, int]]:
    """Code points whose lower-cased form lies in ``lo..hi`` (which holds no upper-case intent)."""
    spans = [(lo, min(hi, 64)), (max(lo, 91), hi)]
    letters = (max(lo, 97) - 32, min(hi, 122) - 32)
    return [s for s in [*spans, letters] if s[0] <= s[1]]


def _bracket(pattern: str, start: int, fold: bool) -> tuple[str, int] | None:
    """Read the bracket that opens at ``start``: its regex and the index behind it."""
    i = start + 1
    negated = i < len(pattern) and pattern[i] in "!^"
    i += negated
    spans: list[tuple[int, int]] = []
    first = True

    def take(at: int) -> tuple[str, int] | None:
        """One member character: escaped, a one-character collating symbol, or plain."""
        if at >= len(pattern):
            return None
        if pattern[at] == "\\":
            return (pattern[at + 1], at + 2) if at + 1 < len(pattern) else None
        for mark in ("[.", "[="):
            if pattern.startswith(mark, at) and pattern[at + 3 : at + 5] == mark[1] + "]":
                return pattern[at + 2], at + 5
        return pattern[at], at + 1

    while True:
        if i >= len(pattern):
            return None
        if pattern[i] == "]" and not first:
            break
        first = False
        if pattern.startswith("[:", i):
            end = pattern.find(":]", i + 2)
            name = pattern[i + 2 : end] if end > 0 else ""
            if name in _CLASSES:
                spans += _CLASSES[name]
                i = end + 2
                continue
            if name.isascii() and name.isalpha() and name.islower():
                return NOTHING, len(pattern)  # an unknown class fails the whole pattern
        member = take(i)
        if member is None:
            return None
        low, i = member
        high = low
        if pattern[i:] == "-":
            # A range without an end fails the whole pattern, unless the bracket took a "[" before.
            took = low == "[" or any(lo <= ord("[") <= hi for lo, hi in spans)
            return None if took else (NOTHING, len(pattern))
        if pattern.startswith("-", i) and i + 1 < len(pattern) and pattern[i + 1] != "]":
            member = take(i + 1)
            if member is None:
                return None
            high, i = member
        if fold:
            spans += _unfold(ord(_lower(low)), ord(_lower(high)))
        elif low <= high:
            spans.append((ord(low), ord(high)))
    body = "".join(f"{_code(lo)}-{_code(hi)}" for lo, hi in spans)
    if negated:
        return (f"[^{body}]" if body else "."), i + 1
    return (f"[{body}]" if body else NOTHING), i + 1


def _translate(pattern: str, fold: bool, name: bool) -> tuple[str, bool]:
    """The regex and whether it holds a bracket; with ``name`` nothing matches a separator."""
    anything = r"[^/\\]" if name else "."
    out: list[str] = []
    brackets = False
    i = 0

    def literal(ch: str) -> str:
        return NOTHING if name and ch in "/\\" else _literal(ch, fold)

    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            if not out or out[-1] != anything + "*":
                out.append(anything + "*")
            i += 1
        elif ch == "?":
            out.append(anything)
            i += 1
        elif ch == "\\":
            if i + 1 == len(pattern):
                return NOTHING, brackets
            out.append(literal(pattern[i + 1]))
            i += 2
        elif ch == "[" and (found := _bracket(pattern, i, fold)):
            brackets = True
            out.append((r"(?![/\\])" if name else "") + found[0])
            i = found[1]
        else:
            out.append(literal(ch))
            i += 1
    return "".join(out), brackets


def _body(pattern: str, name: bool = False) -> str:
    """The regex of one glob, without anchors."""
    folded, brackets = _translate(pattern, True, name)
    if not brackets:
        return folded
    # A bracket can match exactly what it refuses after folding, as [!a] does with A.
    exact, _ = _translate(pattern, False, name)
    return folded if exact == folded else f"{folded}|{exact}"


def _any(patterns: Sequence[str], name: bool = False) -> str:
    bodies = [_body(p, name) for p in dict.fromkeys(patterns) if p]
    return f"(?:{'|'.join(bodies) if bodies else NOTHING})"


# Where a last name begins: a name never holds a separator itself.
_NAME_START = r"(?:\A|[/\\])"


def glob_alternation(patterns: str | Sequence[str]) -> str:
    """One regex, to be matched in full, for what any of the globs matches."""
    return "(?s)" + _any([patterns] if isinstance(patterns, str) else patterns)


def whole_regex(patterns: Sequence[str]) -> str:
    """Finds strings that any glob matches as a whole."""
    return rf"(?s)\A{_any(patterns)}\z"


def path_or_name_regex(patterns: Sequence[str], omittable: str = "") -> str:
    """Finds paths that match as a whole, by last name, or without the prefix ``omittable``."""
    prefix = f"(?:{omittable})?" if omittable else ""
    return (
        rf"(?s)(?:\A{prefix}{_any(patterns)}|{_NAME_START}{_any(patterns, name=True)})\z"
    )


def at_or_above_regex(patterns: Sequence[str]) -> str:
    """Finds paths of which they themselves or a directory above match, as a whole or by name."""
    return (
        rf"(?s)(?:\A{_any(patterns)}|{_NAME_START}{_any(patterns, name=True)})(?=/|\z)"
    )


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    """True where any glob matches ``value``; all of them are one regex."""
    return F.rlike(value, F.lit(whole_regex(patterns)))
