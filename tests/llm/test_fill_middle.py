import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tenderspark.llm import fill_middle as fm

TEXTS = [
    "abc", None, "", "a<P>b", "<S>", "<M", "x\U0001f600y\nz" * 500, "日本語\r\n" * 90, " ", "\n\n", "a" * 255, "b" * 256, "c" * 257, "<" * 40, "$1 \\ ${x} {3}+", "é" * 300, " \u0085\x00",
]


def plain(doc_id, text):
    """(n, form, prefix, middle, output) by slices."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_against_slices(spark):
    r = random.Random(3)
    texts = TEXTS * 8 + ["".join(r.choice("ab \n<>PSMé日\U0001f600") for _ in range(r.randint(0, 700))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "no id"), (-5, "below"), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fm.fill_in_middle(docs).withColumn("again", fm.restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows)
    for x in made:
        assert (x.n, x.form, x.prefix_units, x.middle_units, x.output) == plain(x.doc_id, x.text)
        assert x.again == (x.text or "")
    assert {x.form for x in made} == {"plain", "psm", "spm"}


def test_other_units(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i)) + " \n") for i in range(600)], "doc_id long, text string")
    made = fm.fill_in_middle(docs, unit=fm.WORD, plain_from=100, spm_below=50).withColumn("again", fm.restored(F.col("output"), F.col("form"))).collect()
    for x in made:
        assert x.n == x.doc_id and x.again == x.text
        if x.form == "psm":
            prefix, rest = x.output.removeprefix("<P>").split("<S>")
            assert len(prefix.split()) == x.prefix_units and len(rest.split("<M>")[1].split()) == x.middle_units
    assert {x.form for x in made} == {"psm", "spm"}


def test_long_text_and_seeds(spark):
    text = "0123456789\n" * 300_000
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    made = fm.fill_in_middle(docs, plain_from=100).select("n", F.length("output").alias("size"), (fm.restored(F.col("output"), F.col("form")) == text).alias("same")).collect()
    assert [tuple(x) for x in made] == [(len(text), len(text) + 9, True)] * 3
    one, two = ([x.prefix_units for x in fm.fill_in_middle(docs, seed=s, plain_from=100).collect()] for s in (1, 2))
    assert one != two


def test_tables(spark):
    docs = spark.createDataFrame([(1, "abc", 7, "x", "q"), (1, "abc", 7, "x", "q")], "doc_id long, text string, n long, first_cut string, form string")
    one, two = fm.fill_in_middle(docs).collect()
    assert one == two and one.first_cut == "x" and one.n == 3
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit,text,n", [(fm.CODE_POINT, "a\nb", 3), (fm.WORD, " a  b ", 2), (r"[^\n]*+\n", "a\n\nb", 2)])
def test_unit_count(spark, unit, text, n):
    assert spark.createDataFrame([(text,)], "text string").select(fm.unit_count(F.col("text"), unit)).first()[0] == n
