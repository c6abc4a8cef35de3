"""Personal data: a linear-chain conditional random field over word-shape features beside four exact rules.

The rules fix emails, IP addresses, cards and phones in their strict forms. The field, trained from a small labelled
table, reads the same data in other forms (spelled-out emails, phones without a country code, cards grouped otherwise or
side by side, IPv6); its path is clamped to the rules' spans, so those stay and what it adds lies beside them. What it adds is
checked exactly (digit counts, Luhn, an at-sign or its word).

A token can carry a label only if its word (what lies between white space) or one of the REACH words on either side holds a
digit, an at-sign or a spelled-out one; all others are outside by definition, so the chain falls apart into stretches that
are decoded on their own, with the same result as over whole texts. Decoding runs in numpy over the stretches of a batch.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; spans come by kind as
listed and then by start; repeated rows give equal rows; other columns are ignored. The scan is narrow, so a hot source or a
very long text costs its own length only: every rule is linear.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.llm import crf
from tenderspark.llm.secrets import masked, pieces

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = BASE_KINDS + [f"crf_{k}" for k in BASE_KINDS]
LABELS = crf.bio(BASE_KINDS)
SPANS = "array<struct<kind:string,start:long,end:long>>"
MAX_TRAINING_ROWS = 2000
REACH = 3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its run of digits does: if it fails there, it fails within the run.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_personal = re.compile("[0-9@]")
_trigger = re.compile(r"[0-9@]|\bdot\b|[\[(]at[\])]", re.I)
_word = re.compile(r"\S+")
_token = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(map(int, number[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the rules, by kind as listed and then by start."""
    if not _personal.search(text):
        return []
    out, free, after = [], 0, 0
    for m in _domain.finditer(text):
        head = text[max(free, after) : m.start()]  # a local part holds no at-sign, so none before this one is in reach
        start = m.start() - len(head) + len(head.rstrip(_LOCAL))
        after = m.start() + 1
        if start < m.start():
            out.append(("email", start, m.end()))
            free = m.end()
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        if 16 <= len(n := digits(m[0])) <= 19 and luhn(n):
            out.append(("card", *m.span()))
    for m in _phone.finditer(text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _token.finditer(text, start, end)]


def shape(word: str) -> str:
    if word[0].isdigit():
        return f"0{min(len(word), 20)}"
    if word[0].isalpha():
        return ("A" if word[0].isupper() else "a") + ("A" if word[1:].isupper() else "a") * min(len(word) - 1, 3)
    return word


def features(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """Feature names of each token: its shape, its neighbours' words and shapes, whether white space parts them, and how
    many digits its run of digits and separators holds."""
    words = [text[a:b].lower() for a, b in spans]
    shapes = [shape(text[a:b]) for a, b in spans]
    glued = ["_" if i and spans[i][0] == spans[i - 1][1] else " " for i in range(len(spans))]
    run = [0] * len(spans)
    i = 0
    while i < len(spans):
        j = i
        while j < len(spans) and (words[j].isdigit() or words[j] in "()-+./") and (j == i or spans[j][0] - spans[j - 1][1] <= 1):
            j += 1
        run[i:j] = [sum(b - a for a, b in spans[i:j] if "0" <= text[a] <= "9")] * (j - i)
        i = max(j, i + 1)
    out = []
    for i in range(len(spans)):
        f = [f"w={words[i]}", f"s={shapes[i]}", f"g={glued[i]}{shapes[i]}", f"run={min(run[i], 20)}"]
        for d in (-3, -2, -1, 1, 2, 3):
            j = i + d
            inside = 0 <= j < len(spans)
            f.append(f"w{d}={words[j] if inside else ''}")
            if abs(d) < 3:
                f.append(f"s{d}={shapes[j] if inside else ''}")
        before, after = (shapes[i - 1] if i else ""), (shapes[i + 1] if i + 1 < len(spans) else "")
        f += [f"pair={before}{glued[i]}{shapes[i]}", f"next={shapes[i]}{glued[i + 1] if i + 1 < len(spans) else ''}{after}"]
        out.append(f)
    return out


def gold_labels(spans: list[tuple[int, int]], entities: list[tuple[str, int, int]]) -> list[str]:
    """BIO labels of tokens; where entities overlap, the first keeps the token."""
    out = ["O"] * len(spans)
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    for kind, start, end in entities:
        before = None
        for i in range(bisect_right(ends, start), bisect_left(starts, end)):
            if out[i] == "O":
                out[i] = f"{'I' if before == i - 1 else 'B'}-{kind}"
                before = i
    return out


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> crf.Chain:
    """Fit the field to rows (text, spans) of a labelled table of at most `max_rows` rows; more are an error."""
    rows = labelled.select("text", F.transform("spans", lambda s: F.struct(s.kind, s.start, s.end)).alias("spans")).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the labelled table has more than {max_rows} rows")
    return fit(sorted((r.text or "", [tuple(s) for s in r.spans or []]) for r in rows))


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> crf.Chain:
    data = []
    for text, entities in examples:
        spans = tokens_of(text, 0, len(text))
        data.append((features(text, spans), gold_labels(spans, entities)))
    return crf.fit(data, LABELS)


def stretches(text: str) -> list[tuple[int, int, int, int]]:
    """(first, start, end, last): a stretch from start to end may carry labels, its context reaches from first to last."""
    if not _trigger.search(text):
        return []
    words = [m.span() for m in _word.finditer(text)]
    hot = [i for i, (a, b) in enumerate(words) if _trigger.search(text, a, b)]
    out: list[list[int]] = []
    for i in hot:
        lo, hi = max(0, i - REACH), min(len(words) - 1, i + REACH)
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(words[max(0, lo - 2)][0], words[lo][0], words[hi][1], words[min(len(words) - 1, hi + 2)][1]) for lo, hi in out]


def find_personal(texts: list[str | None], chain: crf.Chain) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points for each text, by kind as listed and then by start."""
    found, rank = [base_spans(t or "") for t in texts], {kind: i for i, kind in enumerate(KINDS)}
    where, scores = [], []
    for k, text in enumerate(texts):
        base = sorted(found[k], key=lambda s: s[1:])
        reach = list(accumulate((s[2] for s in base), max))
        starts = [s[1] for s in base]
        for first, start, end, last in stretches(text or ""):
            spans = tokens_of(text, first, last)
            near = base[bisect_right(reach, first) : bisect_left(starts, last)]
            clamped = gold_labels(spans, sorted(near, key=lambda s: (rank[s[0]], s[1])))
            score = crf.emissions(chain, features(text, spans))
            for i, (a, b) in enumerate(spans):
                fixed = clamped[i] if clamped[i] != "O" else "O" if a < start or b > end else None
                if fixed:
                    keep = LABELS.index(fixed)
                    score[i, :keep] = score[i, keep + 1 :] = 2 * crf.NEVER
            where.append((k, spans))
            scores.append(score)
    added: dict[int, list[tuple[str, int, int]]] = {}
    for (k, spans), path in zip(where, crf.viterbi(chain, scores), strict=True):
        added.setdefault(k, []).extend(("crf_" + kind, a, b) for kind, a, b in entities(spans, path))
    for k, extra in added.items():
        taken = np.array(sorted((a, b) for _, a, b in found[k]) or [(-1, -1)])
        reach = np.maximum.accumulate(taken[:, 1])
        beside = [s for s in extra if plausible(s[0], texts[k][s[1] : s[2]]) and not _meets(taken[:, 0], reach, s)]
        found[k] = sorted(found[k] + beside, key=lambda s: (rank[s[0]], s[1]))
    return found


def _meets(starts: np.ndarray, reach: np.ndarray, span: tuple[str, int, int]) -> bool:
    i = int(np.searchsorted(starts, span[2], "left"))
    return i > 0 and reach[i - 1] > span[1]


def entities(spans: list[tuple[int, int]], path: np.ndarray) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for i in np.flatnonzero(path):
        label = LABELS[path[i]]
        if label[0] == "I":
            out[-1] = (*out[-1][:2], spans[i][1])
        else:
            out.append((label[2:], *spans[i]))
    return out


def plausible(kind: str, text: str) -> bool:
    """The exact check of what the field adds."""
    n = digits(text)
    if kind == "crf_card":
        return 13 <= len(n) <= 19 and luhn(n)
    if kind == "crf_phone":
        return 7 <= len(n) <= 15
    if kind == "crf_ip":
        return text.count(":") >= 2 or (text.count(".") == 3 and all(p.isdigit() and int(p) <= 255 for p in text.split(".") if len(p) < 5))
    return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"\.|\bdot\b", text, re.I))


def scan_personal(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """doc_id, text -> doc_id, spans array<struct<kind,start,end>>, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch):
                found = find_personal(part.column(1).to_pylist(), chain)
                spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in row] for row in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """All columns of `docs`; each span of `text` is replaced by [kind]."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                k = columns.index("text")
                texts = part.column(k).to_pylist()
                spans = [sorted(s, key=lambda x: x[1:]) for s in find_personal(texts, chain)]
                clean = [masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                yield part.set_column(k, part.schema.field(k), pa.array(clean, part.column(k).type))

    return docs.mapInArrow(run, docs.schema)


# The labelled table: sentences of invented words around personal data in strict and other forms, and around numbers that
# are none.
CUES = {
    "email": ["mail", "email", "e-mail", "contact", "write to", "correo", "courriel", "reach me", ""],
    "phone": ["tel", "phone", "call", "mobile", "fax", "telefon", "llamar", "appelez", "Tel:", ""],
    "card": ["card", "visa", "credit card", "karte", "tarjeta", "carte", "paid with", ""],
    "ip": ["host", "from", "server", "address", "login from", "ip", ""],
}
TOPS = ["com", "org", "net", "de", "es", "fr", "io", "example.com"]


def _letters(r: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(r.randint(least, most)))


def _plain(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))


def _number(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _card_number(r: random.Random, n: int) -> str:
    head = _number(r, n - 1)
    return next(head + d for d in "0123456789" if luhn(head + d))


def _value(r: random.Random, kind: str) -> str:
    if kind == "email":
        user = r.choice([_plain(r), f"{_plain(r)}.{_plain(r)}", f"{_plain(r)}.{_number(r, 2)}"])
        host, top = r.choice([_plain(r), _plain(r) + _number(r, 1)]), r.choice(TOPS)
        spelled = f"{user.replace('.', ' dot ')} at {host} dot {top.replace('.', ' dot ')}"
        return r.choice([f"{user}@{host}.{top}", f"{user} (at) {host}.{top}", f"{user} [at] {host} [dot] {top}", spelled, f"{user}(at){host}(dot){top}", f"{user} @ {host}.{top}"])
    if kind == "ip":
        if r.random() < 0.3:
            return ":".join(f"{r.randint(0, 65535):x}" for _ in range(r.choice([6, 8])))
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        n = _card_number(r, r.choice([13, 15, 16, 16, 16, 16]))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4)) if sep else n
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{_number(r, 2)} {a} {b}{c}", f"0{a} {b}{c}", f"00{_number(r, 2)} {a} {b} {c}", f"0{_number(r, 2)}/{b}{c}"])


def _other(r: random.Random) -> str:
    """Numbers and words that are no personal data."""
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 24, 40])))
    return r.choice(
        [
            _number(r, r.randint(1, 7)), f"version {_number(r, 1)}.", f"{_number(r, 1)}.{_number(r, 1)}.", f"{_number(r, 1)}.{_number(r, 1)}.{_number(r, 1)}", f"v{_number(r, 1)}.{_number(r, 2)}",
            f"20{_number(r, 2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{_number(r, 2)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/19{_number(r, 2)}",
            f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(0, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"${_number(r, 1)},{_number(r, 3)}", f"{_number(r, 2)}%", f"{_number(r, 3)},{_number(r, 3)},{_number(r, 3)}",
            f'token = "{hexes}"', f"password={hexes[:18]}", f"AKIA{hexes[:16].upper()}", f"section {_number(r, 1)}.{_number(r, 1)}", f"no. {_number(r, 8)}", f"order {_number(r, 9)}", f"978-{_number(r, 1)}-{_number(r, 2)}-{_number(r, 6)}-{_number(r, 1)}",
            f"{_letters(r)} at {_letters(r)}", "dot", f"{_letters(r)} dot {_letters(r)}", f"@{_plain(r)}", f"{_number(r, 3)}x{_number(r, 3)}", f"#{_number(r, 4)}", f"{_number(r, 3)}-{_number(r, 3)}", f"pp. {_number(r, 3)}-{_number(r, 3)}",
            f"{_number(r, 11)}", f"{_number(r, 14)}", f"{_number(r, 20)}", f"({_number(r, 4)})", f"{_number(r, 2)} - {_number(r, 2)}",
        ]
    )


def labelled_examples(rows: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences and their spans (kind, start, end), the same for the same seed."""
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(_letters(r) if r.random() < 0.9 else _letters(r).upper() for _ in range(r.randint(0, 5))) + " "
            if r.random() < 0.55:
                kind = r.choice(BASE_KINDS)
                text += r.choice(CUES[kind]) + " "
                for _ in range(2 if kind == "card" and r.random() < 0.25 else 1):
                    value = _value(r, kind)
                    text = text.lstrip(" ") + r.choice(["", "", "", "(", '"']) if not text.strip() else text
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value + " "
            else:
                text += _other(r) + " "
            text = text[:-1] + r.choice(["", "", ",", ".", ";"]) + " "
        out.append((text + " ".join(_letters(r) for _ in range(r.randint(0, 4))), spans))
    return out


def labelled_table(spark: SparkSession, rows: int = 600, seed: int = 11) -> DataFrame:
    """text, spans: the labelled table that the registered query trains on."""
    return spark.createDataFrame(labelled_examples(rows, seed), f"text string, spans {SPANS}")


def agreement(chain: crf.Chain, examples: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[float, float]:
    """(precision, recall) of whole spans, decoded freely, without the rules."""
    right = made = there = 0
    for text, wanted in examples:
        spans = tokens_of(text, 0, len(text))
        path = crf.viterbi(chain, [crf.emissions(chain, features(text, spans))])[0]
        got = set(entities(spans, path))
        right, made, there = right + len(got & set(wanted)), made + len(got), there + len(wanted)
    return right / max(made, 1), right / max(there, 1)
