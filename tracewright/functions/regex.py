"""Patterns with ASCII word boundaries, on the JVM.

Since Java 17 `\\b` follows Unicode: between "é" and "1" there is no boundary, and a secret beside an accented
letter would stay in a text. Each `\\b` becomes a test of ASCII word characters: only the missing half where the
pattern itself tells what stands on the other side, both halves elsewhere. `$` becomes `\\z`, since Java's also
matches before a final newline, unless a pattern is multi-line.
"""

from __future__ import annotations

import re

W = "[A-Za-z0-9_]"
BEFORE_WORD, AFTER_WORD = f"(?<!{W})", f"(?!{W})"
EITHER = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
#: White space as scripts see it, for trimming: without the plain space, and with it.
LONE = r"[\t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def _starts_with_word(rest: str) -> bool:
    """Whether all that the pattern can match here begins with a word character: literals, and groups or classes of them."""
    m = re.match(r"\((?:\?:)?([^()\[\]\\?*+{}^$|.]+(?:\|[^()\[\]\\?*+{}^$|.]+)*)\)", rest)
    if m:
        return all(re.match(r"\w", x) for x in m[1].split("|"))
    if m := re.match(r"\[([A-Za-z0-9\-]+)\]", rest):
        return not m[1].startswith("-") and not m[1].endswith("-")
    if rest.startswith("\\d"):
        return not re.match(r"\\d[?*]", rest)
    return bool(re.match(r"[A-Za-z0-9_](?![?*])", rest))


def _ends_with_word(before: str) -> bool:
    """Whether what stands before is a class of ASCII letters and digits with a count."""
    return bool(re.search(r"\[[A-Za-z0-9\-]*[A-Za-z0-9]\]\{\d+,?\d*\}$", before) and not re.search(r"\[[^\]]*(?:\\-|[+/_]|-)\]\{\d+,?\d*\}$", before))


def java(pattern: str) -> str:
    """The pattern for regexp functions of Spark."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    multi = bool(flags and "m" in flags[1])
    out, i, in_class = "", 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not in_class:
            rest = pattern[i + 2 :]
            if _starts_with_word(rest) and not out.endswith(("]", "}", ")", "*", "+")) and not re.search(r"\w$", re.sub(r"\(\?[a-z:]*\)?$", "", out)):
                out += BEFORE_WORD
            elif _ends_with_word(out):
                out += AFTER_WORD
            else:
                out += EITHER
            i += 2
        elif two.startswith("\\"):
            out, i = out + two, i + 2
        else:
            c = pattern[i]
            in_class = (in_class or c == "[") and c != "]"
            out, i = out + ("\\z" if c == "$" and not multi and not in_class else c), i + 1
    return out
