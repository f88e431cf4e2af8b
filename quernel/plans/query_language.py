"""The full-text query language: text to a tree of clauses.

Terms are any-of by default; ``AND``, ``OR``, ``NOT``, ``+``, ``-``, parentheses,
``"phrases"``, ``"phrases"~2``, ``"prefix phrases"*``, ``field:``, ``^boost``, ranges
``[a TO b]`` and ``{a TO b}``, ``IN [a b]`` and ``*`` have their usual meaning.
A query that can't be read is taken as one phrase, and one without a word as ``*``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FIELDS = ("title", "body", "tags")
_TOKEN = re.compile(r'\s*(?:(?P<phrase>"(?P<text>(?:[^"\\]|\\.)*)"(?P<tail>\*|~\d+)?)|(?P<mark>[()+\-\[\]{}]|\^\d+(?:\.\d+)?)|(?P<word>(?:[^\s"()\[\]{}^:\\]|\\.)+(?P<colon>:)?))')
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Term:
    """Words in a row in any of the fields; kind: term, phrase, prefix, range, set or all."""

    kind: str
    words: list[str] = field(default_factory=list)
    fields: tuple[str, ...] = FIELDS
    slop: int = 0
    boost: float = 1.0
    inclusive: tuple[bool, bool] = (True, True)


@dataclass
class Clause:
    """Parts that must, may, and must not match."""

    must: list = field(default_factory=list)
    may: list = field(default_factory=list)
    never: list = field(default_factory=list)
    boost: float = 1.0


def words_of(text: str) -> list[str]:
    """The search tokens of a query's text."""
    return [w.lower() for w in _WORD.findall(text) if len(w.encode()) < 40]


class _Reader:
    def __init__(self, text: str):
        self.parts, at = [], 0
        while at < len(text) and text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            self.parts.append(m)
            at = m.end()
        self.at = 0

    def look(self, group: str = "mark") -> str | None:
        return self.parts[self.at][group] if self.at < len(self.parts) else None

    def take(self, group: str = "mark") -> str:
        value = self.look(group)
        if value is None:
            raise ValueError("the query ends early")
        self.at += 1
        return value

    def clause(self, fields: tuple[str, ...]) -> Clause:
        """Parts up to the end or a closing parenthesis."""
        entries, joined = [], None  # [sign, part, joined to the one before by AND or OR]
        while self.at < len(self.parts) and self.look() != ")":
            word = self.look("word")
            if word in ("AND", "OR"):
                if not entries:
                    raise ValueError("an operator stands first")
                joined, self.at = word, self.at + 1
                continue
            sign = ""
            if word == "NOT":
                sign, self.at = "-", self.at + 1
            elif self.look() in ("+", "-"):
                sign = self.take()
            entries.append([sign, self.part(fields), joined])
            joined = None
        if joined or not entries:
            raise ValueError("something is missing")
        out = Clause()
        # runs joined by AND bind more tightly than what is joined otherwise
        runs: list[list] = []
        for sign, part, how in entries:
            (runs[-1] if how == "AND" else runs.append([]) or runs[-1]).append((sign, part))
        for run in runs:
            if len(run) == 1:
                (sign, part), = run
                {"+": out.must, "-": out.never, "": out.may}[sign].append(part)
            else:
                inner = Clause([p for s, p in run if s != "-"], [], [p for s, p in run if s == "-"])
                if len(runs) == 1:
                    return inner
                out.may.append(inner)
        return out

    def part(self, fields: tuple[str, ...]):
        word = self.look("word")
        if word and self.look("colon") and word[:-1]:
            name = word[:-1].lower()
            if name not in (*FIELDS, "path"):
                raise ValueError(f"no field {name}")
            self.at += 1
            return self.part((name,))
        if self.look() == "(":
            self.at += 1
            part = self.clause(fields)
            if self.take() != ")":
                raise ValueError("a parenthesis isn't closed")
        elif self.look() in ("[", "{"):
            part = self.range(fields)
        elif self.look("phrase"):
            text, tail = self.look("text"), self.look("tail") or ""
            self.at += 1
            exact = fields == ("path",)
            part = Term("phrase", [text] if exact else words_of(text), fields, int(tail[1:] or 0) if tail.startswith("~") else 0)
            if tail == "*":
                part.kind = "prefix"
        elif word == "IN" and self.parts[self.at + 1 :] and self.parts[self.at + 1]["mark"] == "[":
            self.at += 2
            values = []
            while self.look() != "]":
                values.append(self.look("text") or self.take("word"))
                self.at += self.look("phrase") is not None and values[-1] == self.look("text")
            self.at += 1
            part = Term("set", [w for v in values for w in words_of(v)], fields)
        elif word == "*":
            self.at += 1
            part = Term("all")
        else:
            text = self.take("word").replace("\\", "")
            part = Term("phrase", [text] if fields == ("path",) else words_of(text), fields)
        if (mark := self.look()) and mark.startswith("^"):
            part.boost, self.at = float(mark[1:]), self.at + 1
        return part

    def range(self, fields: tuple[str, ...]) -> Term:
        low = self.take() == "["
        a = self.take("word")
        if self.take("word") != "TO":
            raise ValueError("a range has no TO")
        b = self.take("word")
        high = self.take() == "]"
        bound = lambda x: "" if x == "*" else x.lower()
        return Term("range", [bound(a), bound(b)], fields, inclusive=(low, high))


def parse(text: str) -> Clause:
    try:
        reader = _Reader(text)
        clause = reader.clause(FIELDS)
        if reader.at < len(reader.parts):
            raise ValueError("a parenthesis too many")
        if any(True for _ in terms(clause)):
            return clause
    except (ValueError, IndexError):
        pass
    words = words_of(text)
    return Clause(may=[Term("phrase", words) if words else Term("all")])


def terms(clause: Clause):
    """The terms of a tree that can match something."""
    for part in (*clause.must, *clause.may, *clause.never):
        if isinstance(part, Clause):
            yield from terms(part)
        elif part.words or part.kind == "all":
            yield part
