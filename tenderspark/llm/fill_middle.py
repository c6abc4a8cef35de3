"""Fill-in-middle: every text is cut into prefix, middle and suffix by one match of a counted-quantifier regex.

`regexp_count` gives n, the number of units of a text. A pattern of its own for every row takes a units possessively as
the prefix, b - a as the middle and the rest as the suffix, so one match captures all three parts and one replacement
lays them out. A unit is a regex; units must tile a text from its start (a code point, or blanks and the word behind
them), and what follows the last whole unit belongs to the suffix.

Defined results: the cuts, the share that stays plain and the layout hang on a hash of seed and doc_id alone, so a row has
the same result in every run and partition; a null text is empty; empty texts and texts that hold a mark stay plain;
a null doc_id hashes as an empty string; repeated rows give equal rows; columns of other names pass through, and those
named as the new ones are replaced. The job is narrow and its memory a few times the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.shared import unused

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
CODE_POINT = "."  # every pattern begins with (?s), so a line feed is a unit too
WORD = r"\s*+\S++"
PLAIN_FROM, SPM_BELOW = 90, 20  # percent: draws from PLAIN_FROM on stay plain, draws below SPM_BELOW put the suffix first
BLOCK = 256  # units counted at once


def counted(unit: str, n: Column | int) -> Column:
    """The pattern of exactly n units, without backtracking."""
    return F.concat(F.lit(f"(?:{unit}){{"), (F.lit(n) if isinstance(n, int) else n).cast("string"), F.lit("}+"))


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """n: whole blocks of units are counted first and then what is behind them, so a text gives few matches to hold."""
    block = f"(?:(?:{unit}){{{BLOCK}}}+)"
    rest = F.regexp_extract(text, rf"(?s)\A{block}*+(.*+)", 1)
    return (F.regexp_count(text, F.lit(rf"(?s)\G{block}")) * BLOCK + F.regexp_count(rest, F.lit(rf"(?s)\G(?:{unit})"))).cast("long")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """All columns of `docs` with n, form (plain, psm or spm), prefix_units, middle_units (null if plain) and output."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = draws(F.col("doc_id"), seed)
    first, second = unused("first_cut", docs), unused("second_cut", docs)
    plain = (text == "") | F.greatest(*(F.contains(text, F.lit(m)) for m in MARKS.values())) | (h[2] % 100 >= plain_from)
    out = docs.withColumn("n", unit_count(text, unit))
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    out = out.withColumns({first: F.least(a, b), second: F.greatest(a, b), "form": form})
    prefix, middle = F.col(first), F.col(second) - F.col(first)
    pattern = F.concat(F.lit(r"(?s)\A("), counted(unit, prefix), F.lit(")("), counted(unit, middle), F.lit(")(.*+)"))
    layout = F.when(F.col("form") == "spm", F.lit("{suffix}$3{prefix}$1{middle}$2".format(**MARKS))).otherwise(F.lit("{prefix}$1{suffix}$3{middle}$2".format(**MARKS)))
    cut = F.col("form") != "plain"
    return out.withColumns(
        {
            "prefix_units": F.when(cut, prefix),
            "middle_units": F.when(cut, middle),
            "output": F.when(cut, F.regexp_replace(text, pattern, layout)).otherwise(text),
        }
    ).drop(first, second)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: no part holds a mark and marks do not overlap, so each occurs once."""

    def part(mark: str, until: str | None) -> Column:
        return F.substring_index(F.substring_index(output, until, 1) if until else output, mark, -1)

    p, s, m = MARKS["prefix"], MARKS["suffix"], MARKS["middle"]
    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h FROM documents),
    e AS (SELECT doc_id, t, length(t) AS n, CAST(concat('0x', substring(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substring(h, 9, 8)) AS BIGINT) AS h2,
                 CAST(concat('0x', substring(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substring(h, 25, 8)) AS BIGINT) AS h4 FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
    g AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM g"""
