"""Secret scans: one combined automaton over all rules, one pass over the bytes.

`scan_secrets` finds for every text the spans of each rule, leftmost and non-overlapping per rule. The forward search
automaton marks where matches of any rule end; for each marked run the reversed automaton gives the possible starts and
the anchored automaton the longest end, so spans come from the automata alone.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows give
equal rows; other columns are ignored. The scan is narrow, so one hot source or a very long text costs only its bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.automaton import Automaton, alt, chars, compile_rules, lit, maybe, plus, reverse, scan, seq, star

_tail = chars("A-Z", "a-z", "0-9", "+/_.=-")
_quote = chars("\"'")
_keyword = alt(*(lit(w, any_case=True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
_head = seq(_keyword, maybe(_quote), star(lit(" ")), chars(":="), star(lit(" ")), maybe(_quote))

# Kind, pattern, least length of the match (0: see _long_enough). The first three are the contract's, the others added.
RULES = [
    ("assign", seq(_head, plus(_tail)), 0),
    ("access", seq(lit("AKIA"), plus(chars("A-Z", "0-9"))), 20),
    ("hex", plus(chars("0-9", "a-f"), 24), 24),
    ("pem", seq(lit("-----BEGIN "), star(chars("A-Z", " ")), lit("PRIVATE KEY-----")), 0),
    ("github", seq(lit("gh"), chars("pousr"), lit("_"), plus(chars("A-Z", "a-z", "0-9"))), 40),
    ("slack", seq(lit("xox"), chars("abprs"), lit("-"), plus(chars("A-Z", "a-z", "0-9", "-"))), 20),
]
KINDS = [k for k, _, _ in RULES]
BASE_KINDS = KINDS[:3]
ASSIGN_VALUE = 6

SPANS = "array<struct<kind:string,start:long,end:long>>"


@functools.cache
def automata() -> tuple[Automaton, Automaton, Automaton]:
    """(search, anchored, reversed anchored); compiled once a process."""
    patterns = [p for _, p, _ in RULES]
    return compile_rules(patterns, True), compile_rules(patterns, False), compile_rules([reverse(p) for p in patterns], False)


@functools.cache
def _assign_head() -> Automaton:
    return compile_rules([_head], False)


def _long_enough(rule: int, data: bytes, start: int, end: int) -> bool:
    if KINDS[rule] == "assign":
        return end - _assign_head().longest(data, start, 0) >= ASSIGN_VALUE
    return end - start >= RULES[rule][2]


def _runs(ends) -> list[tuple[int, int]]:
    """Runs of neighbouring positions as (first, last), the last run first."""
    ends = np.asarray(ends)
    gaps = np.flatnonzero(np.diff(ends) > 1)
    return list(zip(ends[np.append(0, gaps + 1)].tolist(), ends[np.append(gaps, -1)].tolist(), strict=True))[::-1]


def _spans(data: bytes, ends: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, given where the search automaton accepts."""
    search, anchored, backward = automata()
    out = []
    for rule in range(len(RULES)):
        hits = ends[(masks >> rule & 1).astype(bool)]
        todo, cursor = _runs(hits) if len(hits) else [], 0
        while todo:
            first, last = todo.pop()
            if last < cursor:
                continue
            starts = [s for n in backward.lengths_back(data, first, rule) if (s := first + 1 - n) >= cursor]
            if starts:
                cursor = anchored.longest(data, min(starts), rule)
                if _long_enough(rule, data, min(starts), cursor):
                    out.append((min(starts), rule, cursor))
            if last >= cursor and (rest := search.ends(data, cursor, last + 1, rule)):
                todo += _runs(rest)  # what begins behind the last match
    return sorted(out)


def find_secrets(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points for each text, by start and then by kind as listed."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts)  # no rule matches a line feed, which resets the automaton
    at, masks = scan(automata()[0], np.frombuffer(joined, np.uint8))
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(begins, at, side="right") - 1
    for i in np.unique(owner):
        own, data = owner == i, parts[i]
        found = _spans(data, at[own] - begins[i], masks[own])
        plain = len(data) == len(texts[i])
        point = (lambda b: b) if plain else (lambda b, d=data: len(d[:b].decode("utf-8", "surrogatepass")))
        out[i] = [(KINDS[r], point(s), point(e)) for s, r, e in found]
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, spans array<struct<kind,start,end>>, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch):
                found = find_secrets(part.column(1).to_pylist())
                spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in row] for row in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def pieces(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def redact(docs: DataFrame) -> DataFrame:
    """All columns of `docs`; each span of `text` is replaced by [kind]. `n_chars`, where there is one, follows."""
    columns, types = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(columns.index("text")).to_pylist()
                clean = [masked(t, s) if s else t for t, s in zip(texts, find_secrets(texts), strict=True)]
                arrays = list(part.columns)
                arrays[columns.index("text")] = pa.array(clean, arrays[columns.index("text")].type)
                if "n_chars" in columns:
                    k = columns.index("n_chars")
                    arrays[k] = pa.array([n if c is t else len(c) for n, c, t in zip(arrays[k].to_pylist(), clean, texts, strict=True)], arrays[k].type)
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, types)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one gap, named after the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
