"""The part of YAML that settings and vocabularies use: nested mappings and lists by indentation,
quoted and plain scalars, comments, and lists in brackets."""

from __future__ import annotations


def _uncommented(line: str) -> str:
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _scalar(text: str):
    """Strings stay strings; empty is null; [a, b] is a list."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    return t or None


def _key(text: str) -> tuple[str, str] | None:
    """(key, rest) of ``key: rest``; a colon in quotes or inside a word is none."""
    quote = None
    for i, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ":" and (i + 1 == len(text) or text[i + 1] in " \t"):
            return str(_scalar(text[:i])), text[i + 1 :].strip()
    return None


def parse(text: str):
    """The document as dicts, lists and strings."""
    lines = []
    for raw in text.splitlines():
        line = _uncommented(raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    value, rest = _block(lines, 0)
    if rest < len(lines):
        raise ValueError(f"unexpected indentation: {lines[rest][1]}")
    return value


def _block(lines: list[tuple[int, str]], i: int):
    """(value, next line) of the lines from ``i`` on that are indented as it is."""
    if i == len(lines):
        return None, i
    depth, first = lines[i]
    out: dict | list = [] if first == "-" or first.startswith("- ") else {}
    while i < len(lines) and lines[i][0] == depth:
        t = lines[i][1]
        if isinstance(out, list):
            if not (t == "-" or t.startswith("- ")):
                break
            item = t[1:].strip()
            if item and _key(item):  # a mapping that begins on the dash's line
                lines[i] = (depth + len(t) - len(item), item)
                value, i = _block(lines, i)
            elif item:
                value, i = _scalar(item), i + 1
            else:
                value, i = _block(lines, i + 1)
            out.append(value)
            continue
        if not (found := _key(t)):
            raise ValueError(f"no key: {t}")
        key, rest = found
        i += 1
        if rest:
            out[key] = _scalar(rest)
        elif i < len(lines) and (lines[i][0] > depth or lines[i][0] == depth and lines[i][1].startswith("- ")):
            out[key], i = _block(lines, i)
        else:
            out[key] = None
    return out, i
