"""Path patterns (include and exclude) compiled to Java regular expressions, and path components.

A path is written ``/a/b/c``. Patterns: ``!`` in front negates, ``/`` in front anchors, a closing ``/`` is dropped; ``**`` as a
whole segment stands for any number of segments, ``*`` for any run within one, ``?`` for one character, ``[...]`` for a class, ``\\`` takes the
next character as it is. The last pattern that matches decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    pass


def _literal(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def _class(text: str, i: int) -> tuple[str, int]:
    """The class that begins at ``text[i]`` (after the bracket), and where it ends."""
    out, negated, first = "", False, True
    if text[i:i + 1] in ("!", "^"):
        negated, i = True, i + 1
    members: list[str] = []
    while True:
        if i >= len(text):
            raise PatternError("unclosed class")
        c = text[i]
        if c == "]" and not first:
            break
        first = False
        if c == "\\":
            i += 1
            if i >= len(text):
                raise PatternError("a backslash at the end")
            c = text[i]
        i += 1
        if text[i:i + 1] == "-" and text[i + 1:i + 2] not in ("", "]"):
            end, i = text[i + 1], i + 2
            if end == "\\":
                if i >= len(text):
                    raise PatternError("a backslash at the end")
                end, i = text[i], i + 1
            if end < c:
                raise PatternError(f"range {c}-{end}")
            members.append(f"{_literal(c)}-{_literal(end)}")
        else:
            members.append(_literal(c))
    out = "".join(members)
    return (f"[^/{out}]" if negated else f"(?!/)[{out}]"), i + 1


def _segment(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c, i = text[i], i + 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            part, i = _class(text, i)
            out += part
        elif c == "\\":
            if i >= len(text):
                raise PatternError("a backslash at the end")
            out, i = out + _literal(text[i]), i + 1
        else:
            out += _literal(c)
    return out


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: str
    negated: bool
    fold: bool = False

    @property
    def java(self) -> str:
        return ("(?iu)" if self.fold else "") + self.regex


def compile_pattern(text: str, fold: bool = False) -> Pattern:
    body, negated = (text[1:], True) if text.startswith("!") else (text, False)
    anchored, body = body.startswith("/"), body.removeprefix("/")
    body = body.removesuffix("/") if not body.endswith("\\/") else body
    if not body:
        raise PatternError(f"empty pattern {text!r}")
    regex = r"\A" + ("" if anchored else "(?:/[^/]+)*")
    for s in body.split("/"):
        if s == "":
            raise PatternError(f"an empty segment in {text!r}")
        if s in (".", ".."):
            raise PatternError(f"{s!r} in {text!r}")
        if s == "**":
            regex += "(?:/[^/]+)*"
        elif "**" in s.replace("\\*", ""):
            raise PatternError(f"** must be a whole segment in {text!r}")
        else:
            regex += "/" + _segment(s)
    return Pattern(text, regex + r"\z", negated, fold)


class PathFilter:
    def __init__(self, patterns: list[str], fold: list[str] | None = None):
        self.patterns = [compile_pattern(p) for p in patterns] + [compile_pattern(p, True) for p in fold or []]

    def decision(self, path: Column) -> Column:
        """True (matched), False (by a negated pattern) or null: the last pattern that matches ``path`` itself."""
        out = F.lit(None).cast("boolean")
        for p in self.patterns:
            out = F.when(path.rlike(p.java), F.lit(not p.negated)).otherwise(out)
        return out

    def matching(self, path: Column) -> Column:
        """Numbers of the patterns that match ``path``."""
        return F.array_compact(F.array(*[F.when(path.rlike(p.java), F.lit(k)) for k, p in enumerate(self.patterns)]))

    def excluded(self, path: Column) -> Column:
        """Whether ``path`` or a directory above it is excluded: what lies below an excluded directory can't come back."""
        return F.exists(prefixes(path), lambda p: F.coalesce(self.decision(p), F.lit(False)))

    def topmost_excluded(self, path: Column) -> Column:
        """Excluded itself, and nothing above it is."""
        above = F.slice(prefixes(path), 1, F.greatest(F.size(prefixes(path)) - 1, F.lit(0)))
        return F.coalesce(self.decision(path), F.lit(False)) & ~F.exists(above, lambda p: F.coalesce(self.decision(p), F.lit(False)))

    def inherited(self, path: Column, default: bool) -> Column:
        """The decision of ``path`` or else of the nearest directory above that has one; ``default`` without any."""
        return F.aggregate(prefixes(path), F.lit(default), lambda acc, p: F.coalesce(self.decision(p), acc))


def prefixes(path: Column) -> Column:
    """``/a``, ``/a/b``, ... up to the path itself."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def components(locator: Column) -> Column:
    """Of a URL or path: the scheme is stripped, empty and ``.`` parts go, ``..`` becomes ``__parent__``."""
    rest = F.regexp_replace(locator, r"\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    kept = F.filter(F.split(rest, "/"), lambda c: (c != "") & (c != "."))
    return F.transform(kept, lambda c: F.when(c == "..", F.lit("__parent__")).otherwise(c))


def valid_child_name(name: Column) -> Column:
    """One clean component: not empty, ``.`` or ``..``, no slash and no NUL."""
    return (name != "") & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\0")


def select(path: Column, include: PathFilter | None, exclude: PathFilter | None) -> Column:
    """What a restore takes: excludes win; includes are inherited from the nearest decided directory; without includes everything."""
    if include and include.patterns and all(p.negated for p in include.patterns):
        raise PatternError("only negated includes")
    taken = include.inherited(path, False) if include and include.patterns else F.lit(True)
    return taken & ~exclude.excluded(path) if exclude and exclude.patterns else taken


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
