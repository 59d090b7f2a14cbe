"""RE2 patterns as a syntax tree, printed as ``java.util.regex``.

Parsing refuses what RE2 refuses (a missing operand, an unclosed group, a range
that falls, look-around, back-references, possessive operators, counts above
1,000), so a bad pattern fails on the driver before any job.  Printing says every
difference between the dialects explicitly:

* a class is a set of code-point ranges, so nothing in it can be read as a Java
  set operator; Perl and POSIX classes are ASCII;
* ``\\b`` and ``\\B`` are ASCII and stand in a group, so they can be repeated;
* ``.``, ``^`` and ``$`` follow the flags ``s`` and ``m`` and know ``\\n`` only;
* case folding is RE2's simple folding: every character's whole orbit is printed
  (``s`` folds with U+017F, ``k`` with U+212A), never Java's own flag;
* ``U`` swaps greedy and lazy operators; ``\\pN`` and ``\\p{Greek}`` become Java's
  categories and scripts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

LAST = 0x10FFFF
MOST_REPEATS = 1_000
WORD = "0-9A-Za-z_"
BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
NON_BOUNDARY = f"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))"

# FIXED VALUES: Perl and POSIX classes of the dialect as code-point ranges.
PERL = {"d": "09", "s": "\t\n\f\r  ", "w": "09AZ__az"}
POSIX = {"alnum": "09AZaz", "alpha": "AZaz", "ascii": "\x00\x7f", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "digit": "09",
         "graph": "!~", "lower": "az", "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ",
         "word": "09AZ__az", "xdigit": "09AFaf"}
ESCAPES = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
CATEGORIES = {"L", "Lu", "Ll", "Lt", "Lm", "Lo", "M", "Mn", "Mc", "Me", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Ps", "Pe", "Pi",
              "Pf", "Po", "S", "Sm", "Sc", "Sk", "So", "Z", "Zs", "Zl", "Zp", "C", "Cc", "Cf", "Co", "Cs"}


class RegexError(ValueError):
    pass


def ranges(pairs: str) -> list[tuple[int, int]]:
    return [(ord(a), ord(b)) for a, b in zip(pairs[::2], pairs[1::2])]


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def complement(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in merged(parts):
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return out + ([(at, LAST)] if at <= LAST else [])


@lru_cache(maxsize=1)
def orbits() -> dict[int, tuple[int, ...]]:
    """Simple case folding: each code point that has partners, with all of them (itself included)."""
    group: dict[int, set[int]] = {}
    for point in range(LAST + 1):
        ch = chr(point)
        if point in (0x130, 0x131) or not ch.isalpha() and ch.lower() == ch.upper():
            continue  # the dotted and the dotless i fold with nothing
        for other in {ch.lower(), ch.upper(), ch.title()}:
            if len(other) == 1 and other != ch and ord(other) not in (0x130, 0x131):
                both = group.get(point, {point}) | group.get(ord(other), {ord(other)})
                for x in both:
                    group[x] = both
    return {p: tuple(sorted(s)) for p, s in group.items()}


def folded(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if merged(parts) == [(0, LAST)]:
        return parts
    extra = [(x, x) for p, own in orbits().items() if any(a <= p <= b for a, b in parts) for x in own]
    return merged(parts + extra)


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False


@dataclass(frozen=True)
class Node:
    kind: str             # literal, set, any, begin, end, text_begin, text_end, word, not_word, group, concat, choice, repeat
    value: object = None
    parts: tuple = ()


class Parser:
    def __init__(self, pattern: str, flags: Flags):
        self.p, self.i, self.flags, self.names = pattern, 0, flags, set()

    def parse(self) -> Node:
        tree = self.choice()
        if self.i < len(self.p):
            raise RegexError("unexpected )")
        return tree

    def peek(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def take(self) -> str:
        if self.i >= len(self.p):
            raise RegexError("unexpected end of pattern")
        self.i += 1
        return self.p[self.i - 1]

    def choice(self) -> Node:
        options = [self.concat()]
        while self.peek("|"):
            self.i += 1
            options.append(self.concat())
        return options[0] if len(options) == 1 else Node("choice", parts=tuple(options))

    def concat(self) -> Node:
        out: list[Node] = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            self.piece(out)
        return Node("concat", parts=tuple(out))

    def repeat(self) -> tuple[int, int | None] | None:
        c = self.p[self.i:self.i + 1]
        if c and c in "*+?":
            self.i += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        m = re.compile(r"\{([0-9]+)(,([0-9]*))?\}").match(self.p, self.i)
        if not m:
            return None
        self.i = m.end()
        low = int(m[1])
        high = low if m[2] is None else int(m[3]) if m[3] else None
        if max(low, high or 0) > MOST_REPEATS or (high is not None and high < low):
            raise RegexError(f"invalid repeat count {m[0]}")
        return low, high

    def piece(self, out: list[Node]) -> None:
        """Appends the next atom, or repeats what a repetition operator stands behind (flags alone are no operand)."""
        if self.repeat() is not None:
            raise RegexError("missing argument to repetition operator")
        if self.peek("\\Q"):
            stop = self.p.find("\\E", self.i)
            text = self.p[self.i + 2:] if stop < 0 else self.p[self.i + 2:stop]
            self.i = len(self.p) if stop < 0 else stop + 2
            atoms = [Node("literal", (ord(c), self.flags.i)) for c in text]
        else:
            atom = self.atom()
            atoms = [] if atom is None else [atom]
        out += atoms
        before = self.i
        times = self.repeat()
        if times is None:
            return
        if not out:
            raise RegexError("missing argument to repetition operator")
        lazy = self.peek("?")
        self.i += lazy
        after = self.i
        if self.repeat() is not None:
            raise RegexError(f"invalid nested repetition operator: {self.p[before:self.i]}")
        self.i = after
        out[-1] = Node("repeat", (*times, lazy != self.flags.U), (out[-1],))

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == ".":
            return Node("any", self.flags.s)
        if c == "^":
            return Node("begin" if self.flags.m else "text_begin")
        if c == "$":
            return Node("end" if self.flags.m else "text_end")
        if c == "\\":
            kind = {"b": "word", "B": "not_word", "A": "text_begin", "z": "text_end"}.get(self.p[self.i:self.i + 1])
            if kind:
                self.i += 1
                return Node(kind)
            return self.escape(False)
        return Node("literal", (ord(c), self.flags.i))

    def group(self) -> Node | None:
        outer = self.flags
        if not self.peek("?"):
            return self.closed("(", outer)
        m = re.compile(r"\?P?<([^>]*)>").match(self.p, self.i)
        if m and not self.p.startswith(("?<=", "?<!"), self.i):
            if not re.fullmatch(r"[A-Za-z0-9_]+", m[1]) or m[1] in self.names:
                raise RegexError(f"invalid or repeated group name {m[1]!r}")
            self.names.add(m[1])
            self.i = m.end()
            plain = re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", m[1])  # Java's names are narrower
            return self.closed(f"(?<{m[1]}>" if plain else "(", outer)
        m = re.compile(r"\?([imsU]*)(-[imsU]+)?([:)])").match(self.p, self.i)
        if not m or (m[3] == ")" and not (m[1] or m[2])):
            raise RegexError("look-around and other (? groups are not supported by RE2")
        self.i = m.end()
        on, off = m[1], (m[2] or "")[1:]
        self.flags = Flags(*((getattr(outer, f) or f in on) and f not in off for f in "imsU"))
        return None if m[3] == ")" else self.closed("(?:", outer)

    def closed(self, opening: str, outer: Flags) -> Node:
        body = self.choice()
        if not self.peek(")"):
            raise RegexError("missing closing )")
        self.i += 1
        self.flags = outer
        return Node("group", opening, (body,))

    def escape(self, inside: bool) -> Node:
        """After a backslash: a literal, or a set."""
        e, fold = self.take(), self.flags.i
        if e in "pP":
            name = self.take()
            if name == "{":
                stop = self.p.find("}", self.i)
                if stop < 0:
                    raise RegexError("missing closing }")
                name, self.i = self.p[self.i:stop], stop + 1
            negative = (e == "P") != name.startswith("^")
            return self.unicode(name.lstrip("^"), negative)
        if e.lower() in PERL:
            own = ranges(PERL[e.lower()])
            own = folded(own) if fold else own
            return Node("set", (complement(own) if e.isupper() else own, ()), (e,) if not (fold or inside) else ())
        if e in ESCAPES:
            return Node("literal", (ESCAPES[e], False))
        if e == "x":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(self.p, self.i)
            if not m or int(m[1] or m[2], 16) > LAST:
                raise RegexError("invalid \\x escape")
            self.i = m.end()
            return Node("literal", (int(m[1] or m[2], 16), fold))
        if e == "0" or (e in "1234567" and self.p[self.i:self.i + 1] in set("01234567")):
            m = re.compile("[0-7]{0,2}").match(self.p, self.i)
            self.i = m.end()
            return Node("literal", (int(e + m[0], 8), fold))
        if e.isascii() and e.isalnum():
            raise RegexError(f"unsupported escape \\{e} (RE2 has no back-references)")
        if not e.isascii():
            raise RegexError(f"invalid escape \\{e}")
        return Node("literal", (ord(e), fold))

    def unicode(self, name: str, negative: bool) -> Node:
        if name == "Any":
            return Node("set", ([] if negative else [(0, LAST)], ()))
        if self.flags.i and name in ("Lu", "Ll", "Lt"):
            raise RegexError(f"case folding of \\p{{{name}}} is not supported")
        if name not in CATEGORIES and not re.fullmatch(r"[A-Z][A-Za-z_]+", name):
            raise RegexError(f"invalid character class {name!r}")
        java = name if name in CATEGORIES else "Is" + name
        return Node("set", ([], (f"\\{'P' if negative else 'p'}{{{java}}}",)))

    def bracket(self) -> Node:
        negative = self.peek("^")
        self.i += negative
        own: list[tuple[int, int]] = []
        named: list[str] = []
        first = True
        while first or not self.peek("]"):
            first = False
            m = re.compile(r"\[:(\^?)([a-z]+):\]").match(self.p, self.i)
            if m:
                if m[2] not in POSIX:
                    raise RegexError(f"invalid character class range: {m[0]}")
                self.i = m.end()
                got = ranges(POSIX[m[2]])
                got = folded(got) if self.flags.i else got
                own += complement(got) if m[1] else got
                continue
            low = self.member()
            if low.kind == "set":
                own += low.value[0]
                named += low.value[1]
                continue
            a = b = low.value[0]
            if self.peek("-") and not self.peek("-]"):
                self.i += 1
                high = self.member()
                if high.kind == "set" or high.value[0] < a:
                    raise RegexError("invalid character class range")
                b = high.value[0]
            own += folded([(a, b)]) if self.flags.i else [(a, b)]
        self.i += 1
        if negative and not named:
            return Node("set", (complement(own), ()))
        return Node("set", (merged(own), tuple(named), negative))

    def member(self) -> Node:
        if self.i >= len(self.p):
            raise RegexError("missing closing ]")
        c = self.take()
        return self.escape(True) if c == "\\" else Node("literal", (ord(c), False))


def _point(p: int) -> str:
    c = chr(p)
    if c.isascii() and c.isalnum() or c == "_":
        return c
    return {9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 32: " "}.get(p, f"\\x{{{p:X}}}" if not c.isalpha() else c)


def _set(own: list[tuple[int, int]], named: tuple = (), negative: bool = False) -> str:
    if not own and not named:
        return f"[^\\x{{0}}-\\x{{{LAST:X}}}]"
    body = "".join(_point(a) if a == b else _point(a) + _point(b) if b == a + 1 else f"{_point(a)}-{_point(b)}" for a, b in own)
    return f"[{'^' if negative else ''}{body}{''.join(named)}]"


def _printed(n: Node, drop_boundaries: bool) -> str:
    if n.kind == "literal":
        point, fold = n.value
        own = orbits().get(point) if fold else None
        if own:
            low = sorted(own, key=lambda p: (p > 0x7F, chr(p).isupper(), p))
            return "[" + "".join(map(chr, low)) + "]"
        c = chr(point)
        if c.isalnum() or c in " _-/,:;'\"=<>!@%&~`#":
            return c
        return "\\" + c if c in "\\.^$|?*+()[]{}" else _point(point)
    if n.kind == "set":
        if n.parts and n.parts[0] in "dsw":
            return {"d": "[0-9]", "s": "[\\t\\n\\f\\r ]", "w": f"[{WORD}]"}[n.parts[0]]
        return _set(*n.value)
    if n.kind in ("concat", "choice"):
        return ("|" if n.kind == "choice" else "").join(_printed(x, drop_boundaries) for x in n.parts)
    if n.kind == "group":
        return f"{n.value}{_printed(n.parts[0], drop_boundaries)})"
    if n.kind == "repeat":
        low, high, lazy = n.value
        body = _printed(n.parts[0], drop_boundaries)
        if n.parts[0].kind not in ("literal", "set", "any", "group"):
            body = f"(?:{body})"
        mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get(
            (low, high), f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
        return body + mark + ("?" if lazy else "")
    if n.kind == "any":
        return f"[\\x{{0}}-\\x{{{LAST:X}}}]" if n.value else "[^\\n]"
    if n.kind in ("word", "not_word"):
        return "" if drop_boundaries and n.kind == "word" else BOUNDARY if n.kind == "word" else NON_BOUNDARY
    return {"begin": "(?:\\A|(?<=\\n))", "end": "(?=\\n|\\z)", "text_begin": "\\A", "text_end": "\\z"}[n.kind]


@lru_cache(maxsize=100_000)
def translate(pattern: str, *, fold: bool = False, drop_boundaries: bool = False) -> str:
    """An equivalent Java regex body.  ``fold``: case-insensitive from the start; ``drop_boundaries`` leaves out ``\\b``
    (for superset prefilters only).  Raises :class:`RegexError` for what RE2 refuses."""
    return _printed(Parser(pattern, Flags(i=fold)).parse(), drop_boundaries)
