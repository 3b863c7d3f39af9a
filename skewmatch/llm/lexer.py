"""Name-literal pairs of source and configuration text, for the secret scan.

One pass reads *heads* (a name that is about to be bound) and the value that follows each: assignments with an optional
type, mapping entries, keyword arguments and subscripts; setter and ``put(name, value)`` calls; tags. A value is a
quoted literal of any quoting (prefixes, escapes, triple quotes, backticks, pieces joined by ``+`` or side by side), a YAML block, or a bare
run of token characters, which may be the name or attribute path of another binding. Such names are resolved over the whole
text: to the last binding before the use, else the first one after it, through any number of steps; keyword arguments
bind nothing outside their call. The text of a quoted literal is read in the same way, with names of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left

Place = tuple[int, int]

HEAD = re.compile(r"""
  (?<![\w.-])["']?(?P<name>[A-Za-z_][\w.-]*+)["']?[ \t]*+\]?[ \t]*+
    (?::[ \t]*+[A-Za-z_][\w.]*+(?:<[\w.,\ ]*+>|\[\])?[ \t]*+(?==))?(?P<op>=>|:=|=(?!=)|:)[ \t]*+
| (?<![A-Za-z0-9])(?:set|put|with|add)_?(?P<setter>[A-Za-z]\w*+)?\([ \t]*+(?:["'](?P<named>[\w.-]++)["'][ \t]*+,[ \t]*+)?(?=[rbuf]{0,2}["'`])
| <(?P<tag>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>(?P<body>[^<>]++)</(?P=tag)>
""", re.X | re.A)
LITERAL = re.compile(r"""[rRbBuUfF]{0,2}(?:\"{3}((?:[^"\\]++|\\.|"(?!""))++)\"{3}|'{3}((?:[^'\\]++|\\.|'(?!''))++)'{3}"""
                     r"""|"((?:[^"\\\n]++|\\.)++)"|'((?:[^'\\\n]++|\\.)++)'|`((?:[^`\\]++|\\.)++)`)""", re.A | re.S)
JOIN = re.compile(r"""[ \t]*+(?:\+\s*+|\\?\n?[ \t]*+)(?=[rRbBuUfF]{0,2}["'])""", re.A)
BLOCK = re.compile(r"[|>][+-]?\d?[ \t]*+\n")
BARE = re.compile(r"[A-Za-z0-9+/_=$.-]+", re.A)
PATH = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", re.A)


def block_at(text: str, at: int, end: int, head: int) -> re.Match | None:
    """The lines from ``at`` on that are indented deeper than the line of the head."""
    line = text.rfind("\n", 0, head) + 1
    deeper = head - line - len(text[line:head].lstrip(" \t")) + 1
    return re.compile(rf"(?:[ \t]{{{deeper},}}[^\n]*+(?:\n|\Z)|[ \t]*+\n)+").match(text, at, end)


def value_at(text: str, at: int, end: int, op: str | None, head: int) -> tuple[list[Place], bool, int]:
    """The places of the value's pieces, whether it is quoted, and where it ends; no places if there is no value."""
    pieces: list[Place] = []
    while match := LITERAL.match(text, at, end):
        pieces.append(match.span(match.lastindex))
        at = match.end()
        more = JOIN.match(text, at, end)
        if not more:
            break
        if "+" not in more[0] and "\n" in more[0] and "\\" not in more[0]:
            break  # a string on the next line is a statement of its own
        at = more.end()
    if pieces:
        return pieces, True, pieces[-1][1] + 1
    if op == ":" and (match := BLOCK.match(text, at, end)) and (match := block_at(text, match.end(), end, head)):
        body = match[0]
        start = match.start() + len(body) - len(body.lstrip())
        return [(start, max(start, match.start() + len(body.rstrip())))], True, match.end()
    if op and (match := BARE.match(text, at, end)):
        return [match.span()], False, match.end()
    return [], False, at


def bindings(text: str, start: int, end: int) -> list[tuple[str, list[Place], bool, bool]]:
    """``(name, places, quoted, constant)`` in the order of the text."""
    out, at, depth = [], start, 0
    while match := HEAD.search(text, at, end):
        depth = max(0, depth + text.count("(", at, match.start()) - text.count(")", at, match.start()))
        if match["tag"]:
            a, b = match.span("body")
            body = match["body"]
            out.append((match["tag"], [(a + len(body) - len(body.lstrip()), b - len(body) + len(body.rstrip()))], True, True))
            at = match.end()
            continue
        places, quoted, after = value_at(text, match.end(), end, match["op"], match.start())
        if places:
            name = match["name"] or match["named"] or match["setter"]
            if name:
                out.append((name, places, quoted, bool(match["op"]) and not (depth and match["op"] == "=")))
            at = after
        else:
            at = match.end()
        if match["op"] is None:
            depth += 1  # the call's bracket
    return out


def resolved(text: str, found: list[tuple[str, list[Place], bool, bool]]) -> list[tuple[str, tuple[Place, ...], bool]]:
    """``(name, places, quoted)`` of every binding, a bare name replaced by the literal that it stands for."""
    where: dict[str, list[int]] = {}
    for k, (name, _, _, constant) in enumerate(found):
        if constant:
            for known in {name, name.rsplit(".", 1)[-1]}:
                where.setdefault(known, []).append(k)

    def target(k: int) -> int | None:
        _, places, quoted, _ = found[k]
        path = text[slice(*places[0])]
        if quoted or not PATH.fullmatch(path):
            return None
        for name in (path, path.rsplit(".", 1)[-1]):
            known = where.get(name, [])
            before = bisect_left(known, k)
            if before:
                return known[before - 1]
            later = [j for j in known[before:before + 2] if j != k]
            if later:
                return later[0]
        return None

    final: dict[int, int] = {}
    for k in range(len(found)):
        chain, at = [], k
        seen = set()
        while at is not None and at not in final and at not in seen:
            seen.add(at)
            chain.append(at)
            ahead = target(at)
            if ahead is None:
                final[at] = at
                break
            at = ahead
        last = final.get(at, chain[-1] if chain else k)
        for j in chain:
            final[j] = last
    return [(name, tuple(found[final[k]][1]), found[final[k]][2]) for k, (name, _, _, _) in enumerate(found)]


def pairs(text: str) -> list[tuple[str, tuple[Place, ...], bool]]:
    """All ``(name, places of the literal's pieces, quoted)`` of a text and of its quoted literals."""
    out, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        found = bindings(text, start, end)
        out += resolved(text, found)
        todo += [p for _, places, quoted, _ in found if quoted for p in places if p[0] < p[1] and (p != (start, end))]
    return out
