"""Heading-aware chunks (F-02..F-04) and Markdown blocks (F-20, F-21).

Chunks are columns: arrays of lines, sections and paragraphs, packed by a fold. Markdown is walked by an Arrow-batched
pandas function on single texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions import text as tx
from tenderspark.functions.columns import let
from tenderspark.functions.drafts import HEADINGS

HISTORY = (1200, 1200, 150)
EXTRACTION_BUDGET = 600_000
BLOCK = "struct<kind:string,level:int,runs:array<struct<text:string,bold:boolean>>>"

OTHER_BREAK = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CUT = "\x00"  # put before a line that opens a section; texts hold none


def _strip(c: Column) -> Column:
    """Without white space around, separators of the old control characters included."""
    return F.btrim(c, F.lit(tx.WHITE_SPACE + "\x1c\x1d\x1e\x1f"))


def sections(text: Column) -> Column:
    """Runs of lines, each begun by a heading (the first may have none), stripped; blank ones go."""
    plain = F.when(text.rlike(OTHER_BREAK[5:]), F.regexp_replace(text, OTHER_BREAK, "\n")).otherwise(text)
    marked = F.transform(F.split(plain, "\n"), lambda line, i: F.when((i > 0) & tx.is_heading(line), F.concat(F.lit(CUT), line)).otherwise(line))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\n" + CUT), _strip), lambda s: s != "")


def packed(items: Column, limit: int) -> Column:
    """items: array of (text, alone). Neighbours are joined by a blank line while they fit; one that is alone stands for
    itself. A fold: what is finished, and the text that still takes more."""
    none = F.array().cast("array<string>")
    closed = lambda a: F.when(a.held == "", a.out).otherwise(F.concat(a.out, F.array(a.held)))
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held"))

    def step(a: Column, x: Column) -> Column:
        joined = F.concat(a.held, F.lit("\n\n"), x.text)
        return (
            F.when(x.alone, state(F.concat(closed(a), F.array(x.text)), F.lit("")))
            .when((a.held != "") & (F.length(a.held) + F.length(x.text) + 2 <= limit), state(a.out, joined))
            .otherwise(state(closed(a), x.text))
        )

    return F.aggregate(items, state(none, F.lit("")), step, closed)


def semantic_chunks(c: Column, target: int = 90_000, most: int = 120_000, overlap: int = 0) -> Column:
    """F-02: array<string>: chunks of at most `most` characters that respect headings, then paragraphs; what has neither is
    cut hard, each cut repeating the last `overlap` characters. A null text has none."""
    step = max(1, most - overlap)
    item = lambda text, alone: F.struct(text.alias("text"), F.lit(alone).alias("alone"))
    hard = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(step)), lambda i: item(F.substring(p, i, F.lit(most)), True))
    parts = lambda s: F.flatten(F.transform(F.split(s, r"(?U)\n\s*\n"), lambda p: F.when(F.length(p) > most, hard(p)).otherwise(F.array(item(p, False)))))
    pieces = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(packed(parts(s), most))

    def whole(t: Column) -> Column:
        every = F.flatten(F.transform(sections(t), pieces))
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(packed(F.transform(every, lambda p: item(p, False)), target))

    return let(_strip(F.coalesce(c, F.lit(""))), whole)


def history_chunks(c: Column) -> Column:
    """F-03."""
    return semantic_chunks(c, *HISTORY)


def extraction_chunks(c: Column, budget: int = EXTRACTION_BUDGET) -> Column:
    """F-04: the whole text while it fits the budget; only longer texts reach the helper."""
    return F.when(F.length(c) <= budget, F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))).otherwise(semantic_chunks(F.when(F.length(c) > budget, c), budget // 4, budget // 2))


def chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    """One row a chunk: doc columns without the text, chunk_idx, chunk. Texts without chunks have no row; the outer form
    keeps the optimiser from asking for the chunks' number first, which would cut every text twice."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.posexplode_outer(chunks).alias("chunk_idx", "chunk")).where("chunk_idx IS NOT NULL")


_bold = re.compile(r"\*\*(.+?)\*\*")
_titles = {h.lower() for h in HEADINGS}


def _runs(text: str) -> list[dict]:
    parts = _bold.split(text)  # plain and bold alternate
    return [{"text": p, "bold": i % 2 == 1} for i, p in enumerate(parts) if p] or [{"text": "", "bold": False}]


def markdown_blocks(text: str | None) -> list[dict]:
    """Headings, bullets and paragraphs; wrapped lines of a paragraph are joined by spaces."""
    out: list[dict] = []
    held: list[str] = []

    def close():
        if held:
            out.append({"kind": "paragraph", "level": 0, "runs": _runs(" ".join(held))})
            held.clear()

    for line in map(str.strip, (text or "").splitlines()):
        mark, _, rest = line.partition(" ") if " " in line else (line.split("\t")[0], "", line.partition("\t")[2])
        if line and 1 <= len(mark) <= 6 and set(mark) == {"#"} and rest.strip():
            close()
            out.append({"kind": "heading", "level": len(mark), "runs": _runs(rest.strip())})
        elif mark in ("-", "*") and rest.strip():
            close()
            out.append({"kind": "bullet", "level": 0, "runs": _runs(rest.strip())})
        elif not held and line.lower() in _titles:
            out.append({"kind": "heading", "level": 2, "runs": _runs(line)})
        elif line:
            held.append(line)
        else:
            close()
    close()
    return out


def parse_markdown(c: Column) -> Column:
    """F-20: array of blocks."""

    @F.pandas_udf(f"array<{BLOCK}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_blocks)

    return run(c)


def markdown_to_text(blocks: Column) -> Column:
    """F-21."""
    line = lambda b: F.concat(F.when(b.kind == "bullet", "• ").otherwise(""), F.array_join(F.transform(b.runs, lambda r: r.text), ""))
    return F.array_join(F.transform(blocks, line), "\n")
