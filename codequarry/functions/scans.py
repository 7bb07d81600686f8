"""Scans over a definition's tokens that carry a state from token to token: heads, marks, brackets and parameters.

These are the row helpers of `signatures.with_shapes`; texts without comments come in Arrow batches.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.pandas.types import from_arrow_type

OPENS, CLOSES = frozenset(("(", "[", "{", "#[")), frozenset((")", "]", "}"))
TURNS = OPENS | CLOSES | {"<", ">"}
SPACE = " \t\n\r\f\v"
_PARAMS = pa.list_(pa.struct([("shape", pa.string()), ("default", pa.string())]))
#: before and after: what stands around the name in front of the parameters; params in Go: the texts alone, as shapes.
ARROW = pa.struct([(name, pa.string()) for name in ("head", "rest", "before", "after", "ret")] + [("params", _PARAMS)])
FOUND = from_arrow_type(ARROW)


def header_end(toks: list[str], lang: str | None, uncalled: bool, angles: bool = True) -> int:
    """How many tokens a definition's head has. Where an angle never closes, as in an operator's name, angles aren't followed."""
    depth = angle = 0
    seen, stops = False, (":",) if lang == "python" else ("{", ";")
    for i, t in enumerate(toks):
        if t == "(" or t == "[":
            depth += 1
        elif t == ")" or t == "]":
            depth = max(depth - 1, 0)
            seen |= t == ")" and depth == 0
        elif depth == 0 and angles and t == "<":
            angle += 1
        elif depth == 0 and angles and t == ">":
            angle = max(angle - 1, 0)
        elif depth == 0 and angle == 0 and (t in stops or t == "=>" or (t == "=" and (seen or uncalled))):
            return i
    return len(toks) if angle == 0 else header_end(toks, lang, uncalled, False)


def without_marks(toks: list[str], lang: str | None) -> list[str]:
    """Tokens without annotations, decorators and attributes outside brackets, their arguments included."""
    if "@" not in toks and "#[" not in toks and lang != "csharp":
        return toks
    out, depth, mode, inner, begun = [], 0, 0, 0, False
    for t in toks:
        turn = (t in OPENS) - (t in CLOSES)
        named = mode == 1 and (t == "." or re.fullmatch(r"\w+", t, re.A) is not None)
        group = (mode == 1 and t == "(") or (mode == 0 and depth == 0 and (t == "#[" or (t == "[" and lang == "csharp" and not begun)))
        inside, mark = mode == 2, mode == 0 and depth == 0 and t == "@"
        inner = 1 if group else inner + turn if inside else 0
        keep = not (mark or named or group or inside)
        again = keep and mode == 1 and depth == 0 and t == "@"
        mode = 1 if again or mark or named else 2 if group or (inside and inner > 0) else 0
        if keep:
            depth += turn
            begun |= t.strip(" ") != ""
            if not again:
                out.append(t)
    return out


def placed(toks: list[str]) -> list[tuple[str, int, int]]:
    """(token, brackets around it, angles around it); a bracket or angle is outside itself."""
    out, d, a = [], 0, 0
    for t in toks:
        if t not in TURNS:
            out.append((t, d, a))
            continue
        deeper = d + (t in OPENS) - (t in CLOSES)
        wider = a + (d == 0 and t == "<") - (d == 0 and t == ">" and a > 0)
        out.append((t, min(d, deeper), min(a, wider)))
        d, a = deeper, wider
    return out


def first(toks: list[tuple[str, int, int]], what: str, since: int = 0) -> int | None:
    """The first place of a token outside all brackets and angles."""
    return next((i for i in range(since, len(toks)) if toks[i] == (what, 0, 0)), None)


def split_top(toks: list[str], sep: str) -> list[str]:
    """The texts of tokens between the separators outside all brackets; blank ones are dropped."""
    parts = [[]]
    for x in placed(toks):
        parts.append([]) if x == (sep, 0, 0) else parts[-1].append(x[0])
    return [s for s in map("".join, parts) if s.strip(SPACE)]


def squeeze(text: str) -> str:
    return re.sub(r"(?<!\w) | (?!\w)", "", re.sub(r"\s+", " ", text, flags=re.A).strip(" "), flags=re.A)


@lru_cache(1 << 14)
def param(part: str, lang: str | None, pattern: re.Pattern) -> tuple[str, str | None]:
    """(shape, default) of one parameter's text: what matters to a caller is its name in Python, else its type."""
    toks = placed(without_marks(pattern.findall(part), lang))
    at = first(toks, "=")
    decl = squeeze("".join(x[0] for x in toks[:at]))
    default = None if at is None else squeeze("".join(x[0] for x in toks[at + 1 :]))
    inner = placed(pattern.findall(decl))
    colon = first(inner, ":")
    name = decl if colon is None else "".join(x[0] for x in inner[:colon])
    if lang == "python":
        return name, default
    if lang in ("java", "csharp", "c", "cpp"):
        bare = decl.removeprefix("final ")
        return re.sub(r"\w+\s*$", "", bare, flags=re.A).strip(" ") if re.search(r"\W", bare, re.A) else bare, default
    dots = "..." if decl.startswith("...") else ""
    if colon is not None:
        return f"{dots}{'?' if name.endswith('?') else ''}:{''.join(x[0] for x in inner[colon + 1 :])}", default
    return f"{dots}_" if lang in ("javascript", "typescript", "tsx") and re.search(r"^\.*\w*$", decl, re.A) else decl, default


def scanned(text: str | None, lang: str | None, kind: str | None, name: str | None, pattern: re.Pattern, callables: tuple[str, ...]) -> dict | None:
    """The parts of a definition, as FOUND tells; before and all behind it are null without a parameter list."""
    if text is None:
        return None
    toks = pattern.findall(text)
    end = header_end(toks, lang, kind is not None and kind not in callables)
    found = {"head": "".join(toks[:end]), "rest": "".join(toks[end:])}
    p = placed(without_marks(toks[:end], lang))
    at = None if name is None else first(p, name)
    opens = None if at is None else first(p, "(", at + 1)
    close = None if opens is None else next((i for i in range(opens + 1, len(p)) if p[i][0] == ")" and p[i][1] == 0), None)
    if close is None or (kind in ("class", None) and lang in ("python", None)):
        return found
    if kind not in callables and not all(a > 0 or t in ("<", ">") or not t.strip(SPACE) for t, _, a in p[at + 1 : opens]):
        return found
    joined = lambda a, z=None: "".join(x[0] for x in p[a:z])
    parts = split_top([x[0] for x in p[opens + 1 : close]], ",")
    params = [(s, None) if lang == "go" else param(s, lang, pattern) for s in parts]
    return found | {"before": joined(0, at), "after": joined(at + 1, opens), "ret": joined(close + 1), "params": [{"shape": s, "default": d} for s, d in params]}
