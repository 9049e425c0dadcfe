"""The running text of a computational notebook's text cells, in any of its spellings."""

from __future__ import annotations

import json

import regex

_FENCE = regex.compile(r"^\s{0,3}(```|~~~)")
_CELL_MARK = regex.compile(r"^# ?%%(.*)$")
_ANSI = regex.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_PROMPT = regex.compile(r"^(In|Out) ?\[[ 0-9*]*\]:")
_HEADING = regex.compile(r"^\s{0,3}#{1,6}(\s|$)")
_UNDERLINE = regex.compile(r"^\s{0,3}(=+|-{2,})\s*$")
_BULLET = regex.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d{1,4}[.)]\s+)?")
_TABLE = regex.compile(r"^\s*\|.*\|\s*$")
# Images, links with their text, addresses, inline code, formulas, tags.
_INLINE = regex.compile(
    r"!?\[[^\]\n]*\](?:\([^)\n]*\)|\[[^\]\n]*\])|<?\b(?:https?|ftp)://[^\s>)]+>?|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]+\$|\\\(.*?\\\)|\\\[.*?\\\]|</?[A-Za-z][^<>\n]*>",
    regex.DOTALL,
)
_STRING = regex.compile(r'"((?:[^"\\]|\\.)*)"?')
_SOURCE = regex.compile(r'"source"\s*:\s*(\[?)')


def _notebook(text: str) -> list[str]:
    """Sources of the text cells of notebook JSON; of a file that is cut off, those up to the cut."""
    try:
        cells = json.loads(text, strict=False)["cells"]
    except (ValueError, KeyError, TypeError, RecursionError):
        cells = _cut_cells(text)
    out = []
    for c in cells if isinstance(cells, list) else []:
        if isinstance(c, dict) and c.get("cell_type") == "markdown":
            s = c.get("source")
            if isinstance(s, list):
                s = "".join(x for x in s if isinstance(x, str))
            if isinstance(s, str):
                out.append(s)
    return out


def _cut_cells(text: str) -> list[dict]:
    start = regex.search(r'"cells"\s*:\s*\[', text)
    if start is None:
        return []
    decoder, at, cells = json.JSONDecoder(strict=False), start.end(), []
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            cell, at = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            break
        cells.append(cell)
    rest = text[at:]
    source = _SOURCE.search(rest) if regex.search(r'"cell_type"\s*:\s*"markdown"', rest) else None
    if source:  # a text cell cut off within its source
        lines = []
        for m in _STRING.finditer(rest, source.end()):
            try:
                lines.append(json.loads(f'"{m[1]}"', strict=False))
            except ValueError:
                lines.append(m[1])
            if not source[1] or regex.match(r"\s*\]", rest, pos=m.end()):
                break
        cells.append({"cell_type": "markdown", "source": lines})
    return cells


def _percent(lines: list[str]) -> list[str]:
    out: list[list[str]] = []
    keep = False
    for line in lines:
        mark = _CELL_MARK.match(line)
        if mark:
            keep = "[markdown]" in mark[1] or "[md]" in mark[1]
            if keep:
                out.append([])
        elif keep:
            out[-1].append(line[2:] if line.startswith("# ") else line[1:] if line.startswith("#") else line)
    return ["\n".join(x) for x in out]


def _rendered(lines: list[str]) -> list[str]:
    out: list[str] = []
    keep = fresh = True
    fenced = False
    for line in lines:
        if not line.strip():
            out.append("")
            fresh = True
            continue
        if fresh and not fenced:
            # A block is code or a result after its prompt, output if it is indented, text otherwise.
            keep = not (_PROMPT.match(line) or line.startswith(("    ", "\t")))
            fresh = False
        if keep:
            fenced ^= bool(_FENCE.match(line))
            out.append(line)
    return ["\n".join(out)]


def text_cells(text: str, nb_format: str | None) -> list[str]:
    """The text cells' markdown. Without a format it is told from the text itself."""
    text = text.lstrip("﻿")
    kind = (nb_format or "").strip().lower()
    head = text.lstrip()[:1]
    if kind not in ("ipynb", "percent", "rendered") or (kind == "ipynb") != (head == "{"):
        kind = "ipynb" if head == "{" else "percent" if regex.search(r"^# ?%%", text, regex.MULTILINE) else "rendered"
    if kind == "ipynb":
        return _notebook(text)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return _percent(lines) if kind == "percent" else _rendered(lines)


def passages(markdown: str) -> list[str]:
    """Paragraphs and list items of a cell, without headings, fenced code, formulas, links, images and tables."""
    markdown = _ANSI.sub("", markdown.replace("\r\n", "\n").replace("\r", "\n"))
    kept: list[str] = []
    fenced = False
    for line in markdown.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            kept.append("")
        elif fenced or _HEADING.match(line) or _TABLE.match(line):
            kept.append("")
        elif _UNDERLINE.match(line):
            if kept:
                kept[-1] = ""
            kept.append("")
        elif line.startswith(("    ", "\t")) and (not kept or not kept[-1]):
            kept.append("")  # indented code
        else:
            kept.append(line)
    plain = "\n".join(kept)
    if "$" in plain or "[" in plain or "`" in plain or "<" in plain or "://" in plain or "\\" in plain:
        plain = _INLINE.sub(" ", plain)
    out: list[str] = []
    for line in plain.split("\n"):
        mark = _BULLET.match(line)
        body = line[mark.end() :].strip()
        if not body:
            out.append("")
        elif mark.end() > len(line) - len(line.lstrip()) or not out or not out[-1]:
            out.append(body)
        else:
            out[-1] += " " + body
    return [x for x in out if x]
