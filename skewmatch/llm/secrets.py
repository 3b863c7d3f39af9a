"""Secret scans: fixed patterns, and assignment-aware lexing.

:mod:`skewmatch.llm.lexer` reads the pairs of names and literals of source and configuration syntax and resolves constants. A literal
scores by the sensitive words in the names that it is bound to and by its own look (length, classes of
characters, entropy); from ``THRESHOLD`` on its place is reported (kind ``lexed``), each piece of a joined literal as a find of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from skewmatch.llm.common import id_text
from skewmatch.llm.lexer import pairs

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")

NAME_WORDS = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
              "credentials": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "authtoken": 3, "auth": 2, "bearer": 2,
              "key": 1, "salt": 1, "signature": 1, "private": 1, "access": 1, "api": 1, "client": 1, "session": 1}
THRESHOLD = 5
_ARMOR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----")  # of PEM keys
_BREAK = re.compile(r"[ \t]*+\n\s*+")  # lines of a block
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DULL = re.compile(r"(?:x+|\*+|\.+|<.*>|\$\{?.*|true|false|null|none|changeme|example|your.*)$", re.I)


def name_score(name: str) -> int:
    """Sensitive words of a name in camel, snake, kebab or dotted case; neighbours count joined too."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:])]
    return sum(NAME_WORDS.get(w, 0) for w in [*words, *joined])


def literal_score(text: str, quoted: bool = False) -> int:
    """How much a literal looks like a secret rather than a word or a placeholder (-3 to 3). A bare word of one class is a word."""
    text = _BREAK.sub("", _ARMOR.sub("", text)).strip()
    if len(text) < 8 or " " in text or _DULL.match(text):
        return -3
    classes = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit))
    n = len(text)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
    return (classes >= 2) + (entropy >= 3) + (n >= 16) - 3 * (classes == 1 and not quoted and not text.isdigit())


def lexed(text: str) -> list[tuple[int, int]]:
    """Places of the literals whose names (direct, or through constants) are sensitive enough."""
    best: dict[tuple[tuple[int, int], ...], tuple[int, bool]] = {}
    for name, places, quoted in pairs(text):
        best[places] = max(best.get(places, (0, quoted)), (name_score(name), quoted))
    return sorted({p for places, (score, quoted) in best.items() if score >= 3
                   and score + literal_score("".join(text[slice(*p)] for p in places), quoted) >= THRESHOLD for p in places})


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all finds in a whole text, in code points, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "(" in text or "</" in text:
        found += [(a, 3, b) for a, b in lexed(text)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_batches(batches):
    for batch in batches:
        rows = [spans(t.as_py()) for t in batch["text"]]
        base = [[x for x in r if x[1] < 3] for r in rows]
        yield pa.record_batch(
            [batch["doc_id"], *(pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(4)),
             pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string()),
             pa.array([joined(r) for r in rows], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans``.

    A null text is empty (no finds); a row without ``doc_id`` is scanned too; repeated rows repeat; whole
    texts at any length; an empty table gives no rows; other columns are ignored. Narrow: no shuffle.
    """
    return id_text(docs, id_col, text_col).mapInArrow(
        scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every find replaced by ``mark`` (overlapping finds once)."""
    out, at = [], 0
    for start, _, end in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
