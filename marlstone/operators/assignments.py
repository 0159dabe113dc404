"""Files of assignments ``PC.name = value;`` read as tokens: scalars, vectors and cell arrays; windows and exclusions are then read from the values."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKENS = re.compile(
    r"""(?P<text>'[^'\n]*') | (?P<note>%[^\n]*) | (?P<more>\.\.\.[^\n]*\n?) | (?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))
      | (?P<name>[A-Za-z_]\w*(?:\.\w+)*) | (?P<line>\n) | (?P<gap>[^\S\n]+) | (?P<mark>.)""",
    re.VERBOSE,
)
OPEN, CLOSE = "{[(", "}])"
#: Words of a window's note, or else its name, and the role that they tell.
ROLE_BY_WORD = {"backward": "backward_only", "certifier": "forward_certifier", "forward": "forward_certifier", "middle": "middle"}
ROLE_BY_NAME = {"W1": "backward_only", "W4": "forward_certifier"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class Assignment(NamedTuple):
    """A name and the tokens of its value; ``note``: the comment behind it; ``source``: its text."""

    name: str
    value: list[Token]
    note: str
    source: str


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup or "", m[0], m.start()) for m in _TOKENS.finditer(text)]


def assignments(text: str, root: str = "PC") -> Iterator[Assignment]:
    """Assignments that begin a line with a name below ``root``. One ends at a semicolon outside of brackets, or, unfinished, with its line; then it has no value."""
    all_tokens, i, fresh = tokens(text), 0, True
    while i < len(all_tokens):
        t = all_tokens[i]
        ahead = next((j for j in range(i + 1, len(all_tokens)) if all_tokens[j].kind != "gap"), None)
        if not (fresh and t.kind == "name" and t.text.startswith(f"{root}.") and ahead is not None and all_tokens[ahead].text == "="):
            fresh = t.kind == "line" or (fresh and t.kind == "gap")
            i += 1
            continue
        depth, value, ended, i = 0, [], False, ahead + 1
        while i < len(all_tokens):
            u = all_tokens[i]
            depth += (u.text in OPEN) - (u.text in CLOSE) if u.kind == "mark" else 0
            if depth <= 0 and (u.kind == "line" or u.text == ";"):
                ended = u.text == ";"
                break
            value.append(u)
            i += 1
        stop = all_tokens[i].at if i < len(all_tokens) else len(text)
        line = text.find("\n", stop)
        rest = text[stop + 1 : line if line >= 0 else len(text)].strip() if ended else ""
        source = text[t.at : stop + ended] + (f" {rest}" if rest else "")
        yield Assignment(t.text[len(root) + 1 :], value if ended else [], rest[1:].strip() if rest.startswith("%") else "", source.strip())


def literal(value: list[Token]):
    """A number, a text, or a vector of numbers with gaps or commas between them; None for anything else."""
    parts = [t for t in value if t.kind not in ("gap", "line", "more", "note")]
    if len(parts) == 1:
        t = parts[0]
        if t.kind == "text":
            return t.text[1:-1]
        if t.kind == "number" and not t.text.startswith("+"):
            return int(t.text) if t.text.lstrip("-").isdigit() else float(t.text)
        return None
    if [t.text for t in parts[:1] + parts[-1:]] != ["[", "]"]:
        return None
    inner = value[value.index(parts[0]) + 1 : value.index(parts[-1])]
    apart = all(a.kind != "number" or b.kind != "number" for a, b in zip(inner, inner[1:]))
    if apart and all(t.kind in ("number", "gap") or t.text == "," for t in inner):
        return [float(t.text) for t in inner if t.kind == "number"]
    return None


def cells(value: list[Token]) -> list[list[str]] | None:
    """The texts of a cell array by row; None if the value is none."""
    parts = [t for t in value if t.kind not in ("gap", "line", "more", "note")]
    if not parts or parts[0].text != "{" or parts[-1].text != "}":
        return None
    rows: list[list[str]] = [[]]
    for t in parts[1:-1]:
        if t.text == ";":
            rows.append([])
        elif t.kind == "text":
            rows[-1].append(t.text[1:-1])
    return rows


def role(name: str, note: str) -> str:
    return next((r for word, r in ROLE_BY_WORD.items() if word in note.lower()), ROLE_BY_NAME.get(name, "middle"))


def window(row: list[str]) -> dict:
    """A window of a row (name, start, end, note)."""
    name, start, end, note = [*row, ""][:4]
    if not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) for d in (start, end)):
        raise ValueError(f"no dates in window {row}")
    return {"name": name, "start": start, "end": end, "note": note, "role": role(name, note)}


def named_windows(scalars: dict) -> list[dict]:
    """Windows given as scalars windows.NAME.start, .end and .role, which are taken out; one without both dates is none."""
    parts: dict[str, dict] = {}
    for key in [k for k in scalars if re.fullmatch(r"windows\.\w+\.(start|end|role)", k)]:
        _, name, part = key.split(".")
        parts.setdefault(name, {})[part] = scalars.pop(key)
    whole = [(n, p) for n, p in sorted(parts.items()) if p.get("start") and p.get("end")]
    return [{"name": n, "start": p["start"], "end": p["end"], "role": p.get("role") or role(n, "")} for n, p in whole]


def read(text: str) -> dict:
    """Scalars, windows, exclusions and embargo of a file; what isn't a literal is listed as unparsed. No window at all is an error.

    Windows are scalars by name or else rows of a cell array, whose role is told by the note or else by the name. Exclusions are pairs of dates, with the comment behind them as rationale.
    """
    scalars: dict = {}
    unparsed, rows, exclusions = [], [], []
    for a in assignments(text):
        table, value = cells(a.value), literal(a.value)
        if a.name == "windows" and table is not None:
            rows = [r for r in table if len(r) >= 3]
        elif a.name == "window_exclusions" and table is not None:
            flat = [c for r in table for c in r]
            exclusions = [{"range": [start, end], "rationale": a.note} for start, end in zip(flat[::2], flat[1::2])]
        elif value is None:
            unparsed.append(a.source)
        else:
            scalars[a.name] = value
    windows = named_windows(scalars) or [window(r) for r in rows]
    if not windows:
        raise ValueError("no windows")
    days = {side: next((scalars[k] for k in (f"embargo_{side}_days", f"embargo_{side}_d") if scalars.get(k)), 0) for side in ("left", "right")}
    return {"scalars": scalars, "windows": windows, "embargo": {f"{side}_days": int(n) for side, n in days.items()}, "exclusions": exclusions, "unparsed": unparsed}


def read_pinned(data: bytes, pin: str | None) -> dict:
    """``read`` of a file whose bytes have the pinned hash, which the result carries. Without a pin, or with another hash, nothing is read."""
    if not pin:
        raise ValueError("no pinned hash: the file can't be verified")
    sha = hashlib.sha256(data).hexdigest()
    if sha != pin:
        raise ValueError(f"hash {sha} isn't the pinned {pin}")
    return read(data.decode(errors="replace")) | {"precommit_sha256": sha}
