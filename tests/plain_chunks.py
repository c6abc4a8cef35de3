"""Heading-aware chunks as a plain walk over lines, to hold the columns against."""

import re

from tenderspark.functions import text as tx

_heading = [re.compile(p) for p in (tx.HEADING_MARKDOWN, tx.HEADING_LABEL, tx.HEADING_CLAUSE)]


def heading_line(line: str) -> bool:
    t = line.strip()
    if not t or len(t) > 120:
        return False
    capitals = len(t) <= 90 and t == t.upper() and sum(map(str.isalpha, t)) >= 3
    return capitals or any(p.match(t) for p in _heading)


def _sections(text: str) -> list[str]:
    """Runs of lines, each begun by a heading (the first may have none)."""
    lines = text.splitlines()
    cuts = [0]
    for i, line in enumerate(lines):
        if i > cuts[-1] and heading_line(line):
            cuts.append(i)
    runs = ("\n".join(lines[a:b]).strip() for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True))
    return [r for r in runs if r]


def _packed(pieces, limit: int) -> list[str]:
    """Neighbours joined by a blank line while they fit; a piece given as a list stands for itself, part by part."""
    out: list[str] = []
    held = ""
    for piece in pieces:
        if isinstance(piece, list):
            out += [held] * bool(held) + piece
            held = ""
        elif held and len(held) + 2 + len(piece) <= limit:
            held = f"{held}\n\n{piece}"
        else:
            out += [held] * bool(held)
            held = piece
    return out + [held] * bool(held)


def chunk(text: str | None, target: int, most: int, overlap: int = 0) -> list[str]:
    """Chunks of at most `most` characters that respect headings, then paragraphs; what has neither is cut hard, each
    cut repeating the last `overlap` characters."""
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    step = max(1, most - overlap)
    pieces: list[str] = []
    for section in _sections(text) or [text]:
        if len(section) <= most:
            pieces.append(section)
            continue
        paragraphs = re.split(r"\n\s*\n", section)
        pieces += _packed(([p[i : i + most] for i in range(0, len(p), step)] if len(p) > most else p for p in paragraphs), most)
    return _packed(pieces, target)
