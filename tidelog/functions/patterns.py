"""Source patterns in RE2's dialect, translated to what Spark's engine takes.

A pattern that RE2 rejects matches nothing, so the translation answers None
for it.  What both engines read alike is passed on; what they read
differently is rewritten: ``$``, ``\\s``, POSIX and Unicode classes, octal and
named-group syntax, brackets within classes, braces that are no repetition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: POSIX class names and their Java names; fixed values.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "digit": r"0-9", "graph": r"\p{Graph}",
    "lower": r"a-z", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r ", "upper": r"A-Z", "word": r"0-9A-Za-z_", "xdigit": r"0-9A-Fa-f",
}
_REPEAT = re.compile(r"[*+?]|\{(\d+)(,(\d*))?\}")
_FLAGS = re.compile(r"\?([ims]*)(-[ims]+)?([:)])")
_NAME = re.compile(r"\?P?<([A-Za-z_]\w*)>")
_MOST = 1000  # repetitions that the dialect allows


class _Rejected(Exception):
    pass


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.out, self.names = text, 0, [], set()

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def translate(self) -> str:
        multiline, stack = False, []
        repeatable = repeated = False  # whether an atom stands before, and whether it has its repetition
        while self.at < len(self.text):
            c = self.peek()
            if repetition := _REPEAT.match(self.text, self.at):
                if not repeatable or repeated:
                    raise _Rejected
                self._check(repetition)
                self.at = repetition.end()
                lazy = self.peek() == "?"
                self.at += lazy
                self.out.append(repetition[0] + "?" * lazy)
                repeated = True
                continue
            repeatable, repeated = True, False
            if c == "(":
                self.at += 1
                before = multiline
                if flags := _FLAGS.match(self.text, self.at):
                    if flags[0] == "?)":
                        raise _Rejected
                    multiline = ("m" in flags[1]) or (multiline and "m" not in (flags[2] or ""))
                    self.at = flags.end()
                    self.out.append("(" + flags[0])
                    if flags[3] == ")":
                        repeatable = False
                        continue
                elif name := _NAME.match(self.text, self.at):
                    if name[1] in self.names:
                        raise _Rejected
                    self.names.add(name[1])
                    self.at = name.end()
                    self.out.append(f"(?<g{len(self.names)}>")  # names here may hold no underscore
                elif self.peek() == "?":
                    raise _Rejected
                else:
                    self.out.append("(")
                stack.append(before)
                repeatable = False
            elif c == ")":
                if not stack:
                    raise _Rejected
                multiline = stack.pop()
                self.at += 1
                self.out.append(")")
            elif c == "[":
                self._class()
            elif c == "\\":
                repeatable = self._escape(False)
            else:
                self.at += 1
                self.out.append({"$": "$" if multiline else r"\z", "{": r"\{", "}": r"\}", "]": r"\]", "#": r"\#"}.get(c, c))
                repeatable = c != "|"
        if stack:
            raise _Rejected
        return "".join(self.out)

    @staticmethod
    def _check(repetition: re.Match) -> None:
        low, high = repetition[1], repetition[3]
        if low and (int(low) > _MOST or (high and (int(high) > _MOST or int(high) < int(low)))):
            raise _Rejected

    def _escape(self, inside: bool) -> bool:
        """Whether a repetition may follow."""
        if self.at + 1 >= len(self.text):
            raise _Rejected
        c = self.text[self.at + 1]
        self.at += 2
        if c == "Q" and not inside:
            end = self.text.find(r"\E", self.at)
            literal = self.text[self.at : end if end >= 0 else len(self.text)]
            self.at = end + 2 if end >= 0 else len(self.text)
            self.out.append("".join(f"\\x{{{ord(x):x}}}" for x in literal))
            return bool(literal)
        if c in "pP":
            self._unicode(c)
        elif c == "s":
            self.out.append(r"\t\n\f\r " if inside else r"[\t\n\f\r ]")
        elif c == "S":
            self.out.append(r"[^\t\n\f\r ]")
        elif c in "dDwWafnrt" or (c == "v"):
            self.out.append({"a": r"\x07", "v": r"\x0B"}.get(c, "\\" + c))
        elif c == "x":
            found = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(self.text, self.at)
            if not found or int(found[1] or found[2], 16) > 0x10FFFF:
                raise _Rejected
            self.at = found.end()
            self.out.append(f"\\x{{{int(found[1] or found[2], 16):x}}}")
        elif c == "0" or (c in "1234567" and self.peek() and self.peek() in "01234567"):
            digits = re.compile("[0-7]{1,2}").match(self.text, self.at)
            value = c + (digits[0] if digits else "")
            self.at += len(value) - 1
            self.out.append(f"\\x{{{int(value, 8):x}}}")
        elif c in "AbBz" and not inside:
            self.out.append("\\" + c)
        elif ord(c) < 128 and not c.isalnum() and c not in "_\x00":
            self.out.append(f"\\x{{{ord(c):x}}}")
        else:
            raise _Rejected
        return True

    def _unicode(self, letter: str) -> None:
        found = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(self.text, self.at)
        if not found:
            raise _Rejected
        self.at = found.end()
        name = found[2] or found[3]
        if found[1]:
            letter = "P" if letter == "p" else "p"
        if name == "Any":
            self.out.append(r"[\x{0}-\x{10FFFF}]" if letter == "p" else r"[^\x{0}-\x{10FFFF}]")
        else:
            self.out.append(f"\\{letter}{{{name if len(name) <= 2 else 'Is' + name}}}")

    def _class(self) -> None:
        self.at += 1
        self.out.append("[")
        if self.peek() == "^":
            self.at += 1
            self.out.append("^")
        first = True
        while True:
            c = self.peek()
            if not c:
                raise _Rejected
            if c == "]" and not first:
                self.at += 1
                self.out.append("]")
                return
            first = False
            if posix := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                if posix[2] not in POSIX:
                    raise _Rejected
                self.out.append(f"[{'^' if posix[1] else ''}{POSIX[posix[2]]}]")
                self.at = posix.end()
            elif c == "\\":
                self._escape(True)
            else:
                self.at += 1
                self.out.append("\\" + c if c in "[]&^" else c)
            if self.peek() == "-" and self.peek(2) != "-]" and len(self.peek(2)) == 2:
                self.at += 1
                self.out.append("-")


def to_java(pattern: str) -> str | None:
    """The pattern for ``rlike``; None where the dialect rejects it."""
    try:
        return "(?d)" + _Reader(pattern).translate()
    except _Rejected:
        return None


def matches(source: Column, pattern: str) -> Column:
    """Unanchored match; the empty pattern matches all, a rejected one nothing."""
    if not pattern:
        return F.lit(True)
    java = to_java(pattern)
    return F.lit(False) if java is None else source.rlike(java)
