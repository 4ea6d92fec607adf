"""Patterns in RE2 syntax as patterns that Spark's rlike reads the same way.

Differences that matter: end anchors, what a dot and \\s match, word boundaries at non-ASCII letters, multi-line anchors, case folding,
and constructs that only one side knows. An invalid pattern gives None.
"""

from __future__ import annotations

import re

#: A word character, whatever case folding is on.
_W = "(?-iu:[0-9A-Za-z_])"
# What each escape becomes outside of a class, and inside of one.
_OUTSIDE = {
    "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "b": f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))",
    "B": f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))", "v": r"\x0B", "a": r"\x07",
    "d": r"\d", "D": r"\D", "w": r"\w", "W": r"\W", "A": r"\A", "z": r"\z", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t",
}
_INSIDE = {"s": r"\t\n\f\r ", "S": r"\S\x0B", "v": r"\x0B", "a": r"\x07"} | {c: "\\" + c for c in "dDwWfnrt"}
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "word": "w", "xdigit": "XDigit"}
#: A part of a pattern that is one word character, for word boundaries next to it, and a quantifier that may leave it out.
_WORD_ATOM = re.compile(r"\\[dw]|[0-9A-Za-z_]")
#: The same where case is folded: k and s have equals that are no ASCII letters.
_FOLDED_ATOM = re.compile(r"\\[dw]|[0-9A-JL-RT-Za-jl-rt-z_]")
_FOLDING = re.compile(r"\(\?[a-zA-Z]*i")
_OPTIONAL = re.compile(r"[*?]|\{0")
_COUNT = re.compile(r"\{(\d+)(,(\d*))?\}")
_MOST_REPEATS = 1000


class _Invalid(Exception):
    pass


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    """The translation of the escape at p[i] == '\\' and the index after it."""
    if i + 1 >= len(p):
        raise _Invalid("trailing back-slash")
    c = p[i + 1]
    table = _INSIDE if inside else _OUTSIDE
    if c in table:
        return table[c], i + 2
    if c in "pPCQ":
        raise NotImplementedError(f"\\{c} is not supported in patterns")
    if m := re.compile(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})").match(p, i):
        return f"\\x{{{m[1] or m[2]}}}", m.end()
    if m := re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(p, i):
        return f"\\x{{{int(m[1], 8):x}}}", m.end()
    if c.isalnum() or ord(c) >= 128:
        raise _Invalid(f"unknown escape \\{c}")  # back references too
    return "\\" + c, i + 2


def _class(p: str, i: int) -> tuple[str, int]:
    """The translation of the class at p[i] == '[' and the index after it."""
    out, j = "[", i + 1
    if p[j : j + 1] == "^":
        out, j = "[^", j + 1
    first = True
    while True:
        if j >= len(p):
            raise _Invalid("missing ]")
        c = p[j]
        if c == "]" and not first:
            return out + "]", j + 1
        first = False
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(p, j):
            if m[2] not in _POSIX:
                raise _Invalid("unknown class")
            name = _POSIX[m[2]]
            out += ("\\W" if m[1] else "\\w") if name == "w" else f"\\{'P' if m[1] else 'p'}{{{name}}}"
            j = m.end()
        elif c == "\\":
            piece, j = _escape(p, j, True)
            out += piece
        else:
            out += "\\" + c if c in "[]&^~" else c
            j += 1


def translate(p: str) -> str | None:
    """A pattern for Java with the meaning that ``p`` has in RE2, or None where ``p`` is invalid there."""
    try:
        return "(?d)" + _translate(p)
    except _Invalid:
        return None


#: The most ways that a pattern may have to go on from one place of a text, for Java to try them.
MOST_WAYS = 4096


def bounded(p: str) -> bool:
    """Whether Java's backtracking does a bounded amount of work at each place of a text, and does not recurse with its length, for a valid pattern ``p``.

    So no group may be repeated, and characters only up to a bound. One unbounded repeat of a character is allowed behind ``^`` at the start, where only one place is tried.
    """
    unbounded, ways, alternatives, i, group = 0, 1, [1], 0, False  # group: what was read last is a group
    flags = re.match(r"(?:\(\?[is]+\))*", p).end()
    anchored, open_alternatives = p.startswith("^", flags), 0
    while i < len(p) and ways <= MOST_WAYS:
        c, was_group, group = p[i], group, False
        count = _COUNT.match(p, i) if c == "{" else None
        if c in "*+?" or count:
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c) or (int(count[1]), int(count[3]) if count[3] else None if count[2] else int(count[1]))
            i += len(count[0]) if count else 1
            i += p[i : i + 1] == "?"
            if was_group and (high is None or high > 1):
                return False
            unbounded += high is None
            ways *= 1 if high is None else high - low + 1
        elif c == "\\":
            i = _escape(p, i, False)[1]
        elif c == "[":
            i = _class(p, i)[1]
        elif c == "(":
            m = re.compile(r"\(\?[^:)>]*([:)>])").match(p, i)
            i = m.end() if m else i + 1
            if not (m and m[1] == ")"):
                alternatives.append(1)
        elif c == ")":
            ways *= alternatives.pop()
            i, group = i + 1, True
        else:
            if c == "|":
                alternatives[-1] += 1
                open_alternatives += len(alternatives) == 1
            i += 1
    once = anchored and not open_alternatives and not re.search(r"\(\?\w*m", p)
    return ways * alternatives[0] <= MOST_WAYS and (not unbounded or unbounded == 1 and once)


def _boundary(p: str, i: int, after_word: bool, atom: re.Pattern) -> str:
    """The translation of the word boundary at p[i]. Next to a part that is surely a word character, only the other side is looked at,
    and first of all whether that part is there, which it is in few places of a text."""
    if after_word:
        return f"(?!{_W})"
    m = atom.match(p, i + 2)
    if m and not _OPTIONAL.match(p, m.end()):
        return f"(?={m[0]})(?<!{_W})"
    return _OUTSIDE["b"]


def _translate(p: str) -> str:
    out: list[str] = []
    many, stack = False, []  # whether (?m) holds; its value outside of each open group
    i, repeatable, repeated = 0, False, False
    atom = _FOLDED_ATOM if _FOLDING.search(p) else _WORD_ATOM
    after_word = False  # whether what was read last is surely a word character
    while i < len(p):
        c = p[i]
        if c in "*+?" or c == "{" and _COUNT.match(p, i):
            if not repeatable or repeated:
                raise _Invalid("nothing to repeat, or repeated twice")
            piece = c
            if c == "{":
                m = _COUNT.match(p, i)
                piece = m[0]
                low, high = int(m[1]), int(m[3]) if m[3] else None
                if max(low, high or 0) > _MOST_REPEATS or high is not None and high < low:
                    raise _Invalid("bad repeat count")
            i += len(piece)
            if p[i : i + 1] == "?":
                piece, i = piece + "?", i + 1
            out.append(piece)
            repeated = True
            after_word = after_word and not _OPTIONAL.match(piece)
            continue
        repeatable, repeated = True, False
        before, after_word = after_word, False
        if p.startswith("\\b", i):
            out.append(_boundary(p, i, before, atom))
            i += 2
        elif c == "\\":
            after_word = p[i + 1 : i + 2] in ("d", "w")
            piece, i = _escape(p, i, False)
            out.append(piece)
        elif c == "[":
            piece, i = _class(p, i)
            out.append(piece)
        elif c == "(":
            if m := re.compile(r"\(\?P?<(\w+)>").match(p, i):
                out.append("(")
                stack.append(many)
                i = m.end()
            elif m := re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(p, i):
                on, off = m[1], m[2] or ""
                if "U" in on + off:
                    raise NotImplementedError("the U flag is not supported in patterns")
                flags = "".join({"i": "iu", "s": "s", "m": ""}[f] for f in on)
                away = "".join({"i": "i", "s": "s", "m": ""}[f] for f in off)
                now = ("m" in on or many) and "m" not in off
                if m[3] == ":":
                    stack.append(many)
                many = now
                text = flags + ("-" + away if away else "")
                out.append(f"(?{text}{m[3]}" if text or m[3] == ":" else "")
                i = m.end()
            elif p.startswith("(?", i):
                raise _Invalid("look-around or unknown group")
            else:
                out.append("(")
                stack.append(many)
                i += 1
            repeatable = False
        elif c == ")":
            if not stack:
                raise _Invalid("unexpected )")
            many = stack.pop()
            out.append(")")
            i += 1
        elif c == "|":
            out.append("|")
            repeatable = False
            i += 1
        else:
            after_word = bool(atom.match(c))
            out.append({"$": r"(?=\n|\z)" if many else r"\z", "^": r"(?:\A|(?<=\n))" if many else r"\A", "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c))
            i += 1
    if stack:
        raise _Invalid("missing )")
    return "".join(out)
