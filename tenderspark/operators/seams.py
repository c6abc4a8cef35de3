"""Batch inference: model calls are functions of the caller, run over Arrow batches; the plumbing around them is here.

A function takes a list of texts and returns a list of as many results. Distinct inputs are called once. What it yields
is written to the shared folder before anything may recompute it; with a memo it is kept there for later runs too, which
call only for what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.functions import drafts
from tenderspark.operators import chunking, matrix
from tenderspark.operators.memo import Memo
from tenderspark.sources.shared import written

HYDE_KEY = 24
REQUIREMENTS = "array<struct<section_number:string,raw_text_content:string,category:string,search_keywords:array<string>>>"


def call_batches(df: DataFrame, fn: Callable[[list], list], column: str, out: str, kind: str, isolate: bool = False) -> DataFrame:
    """`df` with `out` = fn(column), batch by batch. With `isolate` a failing batch is retried row by row and a failing
    row gives null."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, {out} {kind}"

    def one(x):
        try:
            return fn([x])[0]
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pdf[column].tolist()
            try:
                got = list(fn(values)) if values else []
                if len(got) != len(values):
                    raise ValueError(f"{len(got)} results for {len(values)} inputs")
            except Exception:
                if not isolate:
                    raise
                got = [one(x) for x in values]
            yield pdf.assign(**{out: pd.Series(got, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def called(df: DataFrame, fn: Callable[[list], list], column: str, out: str, kind: str, isolate: bool, memo: Memo | None, name: str) -> DataFrame:
    """`call_batches` over `df`, written; through the memo if there is one."""
    if memo is None:
        return written(call_batches(df, fn, column, out, kind, isolate), name)
    return memo.apply(df, column, out, lambda rows: call_batches(rows, fn, column, "value", kind, isolate))


def distinct_before_inference(pairs: DataFrame, fn: Callable[[list[str]], list[str]], memo: Memo | None = None) -> DataFrame:
    """D-05: pairs (title, requirement) with `hyde_key` and `query`: one call for each distinct pair, the plain text
    where the call fails."""
    plain = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("requirement", F.lit("")))
    key = F.concat(F.lit("hyde:"), F.substring(F.sha2(plain, 256), 1, HYDE_KEY))
    tagged = pairs.withColumn("hyde_key", key).withColumn("_plain", plain)
    made = called(tagged.select("hyde_key", "_plain").dropDuplicates(["hyde_key"]), fn, "_plain", "_made", "string", True, memo, "hyde").select("hyde_key", "_made")
    return tagged.join(made, "hyde_key", "left").withColumn("query", F.coalesce(F.nullif("_made", F.lit("")), "_plain")).drop("_plain", "_made")


def embed_chunks(chunks: DataFrame, fn: Callable[[list[str]], list], dim: int, column: str = "content", memo: Memo | None = None) -> DataFrame:
    """I-01: unit vectors of width `dim`; another width fails the job."""

    def unit(texts: list[str]) -> list:
        out = []
        for v in fn(texts):
            x = np.asarray(v, np.float64)
            if x.shape != (dim,):
                raise ValueError(f"an embedding of shape {x.shape}, not {dim}")
            n = np.linalg.norm(x)
            out.append((x / n if n else x).astype(np.float32).tolist())
        return out

    return called(chunks, unit, column, "embedding", "array<float>", False, memo, "embedded")


def extract_requirements(chunks: DataFrame, fn: Callable[[list[str]], list[list[dict]]], categories: list[str], memo: Memo | None = None) -> DataFrame:
    """I-02: rfp_id, chunk_idx, chunk -> a clean matrix. Unknown categories fail the batch, as the schema would."""

    def checked(texts: list[str]) -> list:
        out = fn(texts)
        if bad := {r["category"] for rows in out for r in rows} - set(categories):
            raise ValueError(f"unknown categories {sorted(bad)}")
        return out

    raw = called(chunks.select("rfp_id", "chunk_idx", "chunk"), checked, "chunk", "requirements", REQUIREMENTS, False, memo, "extracted").drop("chunk")
    return matrix.sanitize_matrix(matrix.concat_chunk_requirements(raw))


def extract_summaries(chunks: DataFrame, fn: Callable[[list[str]], list[dict]], sources: DataFrame, memo: Memo | None = None) -> DataFrame:
    """I-03: one citation-checked summary a document; chunks whose call fails count as absent, a document whose chunks
    all fail has a null summary."""
    made = called(chunks.select("rfp_id", "chunk_idx", "chunk"), fn, "chunk", "summary", matrix.SUMMARY, True, memo, "summaries").drop("chunk")
    good = matrix.sanitize_summary(matrix.merge_summaries(made.where("summary IS NOT NULL")), sources)
    return made.select("rfp_id").distinct().join(good, "rfp_id", "left")


def build_library(docs: DataFrame, fn: Callable[[list[str]], list], dim: int, memo: Memo | None = None) -> DataFrame:
    """I-04: tenant, proposal_id, source_name, tags and text -> embedded chunks."""
    rows = chunking.chunk_rows(docs, chunking.history_chunks(F.col("text"))).withColumnRenamed("chunk", "content")
    key = F.sha2(F.concat_ws("\x1f", "tenant", F.coalesce(F.col("proposal_id").cast("string"), F.lit("")), "source_name", F.col("chunk_idx").cast("string"), "content"), 256)
    return embed_chunks(rows.withColumn("chunk_id", key), fn, dim, memo=memo)


def score_drafts(sections: DataFrame, fn: Callable[[list[str]], list[str]], memo: Memo | None = None) -> DataFrame:
    """I-05: sections with `prompt` -> draft, rejection, content, final_status; a failing call fails one section.

    sections: section_id, prompt, requirement_count, require_headings, require_tags, source_context.
    """
    made = called(sections, fn, "prompt", "draft", "string", True, memo, "drafts")
    c = F.col
    rejection = F.when(c("draft").isNull(), "draft_failed").otherwise(drafts.draft_rejection(c("draft"), c("requirement_count"), c("require_headings"), c("require_tags"), c("source_context")))
    x = made.withColumn("rejection", rejection)
    content = F.when(c("rejection").isNull(), F.regexp_replace("draft", r"(?U)^\s+|\s+$", ""))
    status = F.when(c("rejection").isNull(), "saved").when(c("rejection") == "draft_failed", "draft_failed").otherwise("guardrail_rejected")
    return x.withColumn("content", content).withColumn("final_status", status)
