"""From chunk-level extractions to one clean matrix and one summary a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions import text
from tenderspark.functions.columns import let

MIN_CHARS, MAX_CHARS = 5, 4000

CITATION = "struct<value:string,source_quote:string>"
SUMMARY = (
    f"struct<administrative:struct<solicitation_number:{CITATION},title_of_opportunity:{CITATION},agency_or_organization:{CITATION},"
    f"naics_code:{CITATION},set_aside_type:{CITATION}>,"
    f"deadlines:struct<questions_due_date:{CITATION},proposal_due_date:{CITATION},period_of_performance:{CITATION}>,"
    "submission_requirements:struct<submission_method:struct<value:string,description:string,source_quote:string>,"
    "page_limits:array<struct<volume:string,limit:string,source_quote:string>>,"
    "required_volumes_or_sections:array<struct<name:string,description:string,source_quote:string>>>,"
    f"technical_core:struct<primary_objective:{CITATION},key_deliverables:array<struct<title:string,description:string,source_quote:string>>>,"
    "evaluation_factors:array<struct<factor:string,description:string,importance:string,source_quote:string>>,"
    "instructions_to_offerors:array<struct<instruction:string,applies_to:string,source_quote:string>>>"
)
SCALARS = [
    *(f"administrative.{k}" for k in ("solicitation_number", "title_of_opportunity", "agency_or_organization", "naics_code", "set_aside_type")),
    *(f"deadlines.{k}" for k in ("questions_due_date", "proposal_due_date", "period_of_performance")),
    "submission_requirements.submission_method",
    "technical_core.primary_objective",
]
#: List fields with the fields that tell two items apart.
LISTS = {
    "submission_requirements.page_limits": ("volume", "limit"),
    "submission_requirements.required_volumes_or_sections": ("name",),
    "technical_core.key_deliverables": ("title",),
    "evaluation_factors": ("factor",),
    "instructions_to_offerors": ("instruction",),
}


def concat_chunk_requirements(chunks: DataFrame) -> DataFrame:
    """D-02: rfp_id, chunk_idx, requirements (array of structs) -> one row each with extraction_order from 0."""
    rows = chunks.select("rfp_id", "chunk_idx", F.posexplode("requirements").alias("pos", "r"))
    order = F.row_number().over(W.partitionBy("rfp_id").orderBy("chunk_idx", "pos")) - 1
    return rows.select("rfp_id", order.alias("extraction_order"), "r.*")


def sanitize_matrix(raw: DataFrame) -> DataFrame:
    """D-01: trimmed, capped and deduplicated requirements (first by extraction_order wins)."""
    trimmed = text.strip(F.coalesce("raw_text_content", F.lit("")))
    capped = F.when(F.length(trimmed) > MAX_CHARS, text.rstrip(F.substring(trimmed, 1, MAX_CHARS))).otherwise(trimmed)
    section = text.strip(F.coalesce("section_number", F.lit("")))
    clean = raw.withColumns({"raw_text_content": capped, "section_number": F.when(section == "", "N/A").otherwise(section)}).where(F.length("raw_text_content") >= MIN_CHARS)
    first = F.row_number().over(W.partitionBy("rfp_id", F.lower("raw_text_content")).orderBy("extraction_order"))
    return clean.withColumn("_n", first).where("_n = 1").drop("_n")


def rejected_counts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows of each document that sanitising dropped."""
    n = raw.groupBy("rfp_id").agg(F.count("*").alias("n"))
    kept = clean.groupBy("rfp_id").agg(F.count("*").alias("k"))
    return n.join(kept, "rfp_id", "left").select("rfp_id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("rejected"))


def merge_summaries(chunks: DataFrame) -> DataFrame:
    """A-18: rfp_id, chunk_idx, summary -> one summary a document.

    A scalar is the first chunk's node with a value, else the first chunk's; a list is the concatenation without
    repeated items. A document of one chunk keeps its summary as it is.
    """

    def first(path: str) -> Column:
        node = F.col(f"summary.{path}")
        with_value = F.min_by(node, F.when(F.col(f"summary.{path}.value").isNotNull(), F.col("chunk_idx")))
        return F.coalesce(with_value, F.min_by(node, "chunk_idx")).alias(path)

    def lists(path: str) -> Column:
        return F.array_sort(F.collect_list(F.struct("chunk_idx", F.coalesce(f"summary.{path}", F.array()).alias("v")))).alias(path)

    one = chunks.groupBy("rfp_id").agg(F.count("*").alias("n"), F.min_by("summary", "chunk_idx").alias("only"), *map(first, SCALARS), *map(lists, LISTS))

    def merged(path: str) -> Column:
        key = lambda x: F.struct(*(F.coalesce(x[k], F.lit("")) for k in LISTS[path]))
        fresh = lambda every, keys: F.filter(every, lambda x, i: F.array_position(keys, key(x)) == i + 1)
        return let(F.flatten(F.transform(F.col(f"`{path}`"), lambda c: c.v)), lambda every: let(F.transform(every, key), lambda keys: fresh(every, keys)))

    def part(name: str) -> Column:
        own = [p for p in [*SCALARS, *LISTS] if p.startswith(name + ".")]
        if not own:
            return merged(name).alias(name)
        return F.struct(*((merged(p) if p in LISTS else F.col(f"`{p}`")).alias(p.split(".")[1]) for p in own)).alias(name)

    tops = list(dict.fromkeys(p.split(".")[0] for p in [*SCALARS, *LISTS]))
    whole = F.struct(*map(part, tops))
    kind = chunks.schema["summary"].dataType
    return one.select("rfp_id", F.when(F.col("n") == 1, F.col("only")).otherwise(_ordered(whole, tops, kind)).alias("summary"))


def _ordered(whole: Column, tops: list[str], kind) -> Column:
    """`whole` with its fields in the order of the type `kind`."""

    def build(at: Column, dtype) -> Column:
        fields = [at[f.name] if f.dataType.typeName() != "struct" or {"value", "source_quote"} & {x.name for x in f.dataType.fields} else build(at[f.name], f.dataType) for f in dtype.fields]
        return F.struct(*(c.alias(f.name) for c, f in zip(fields, dtype.fields, strict=True)))

    return build(whole, kind)


def sanitize_summary(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """F-12: summaries whose fabricated quotes are gone, and how many there were.

    summaries: rfp_id, summary; sources: rfp_id, text. The source is normalised once a document.
    """
    x = summaries.join(sources.select("rfp_id", text.normalize_ws(F.col("text")).alias("_source")), "rfp_id", "left")
    source, s = F.coalesce("_source", F.lit("")), F.col("summary")
    grounded = lambda quote: text.quote_grounded_in(quote, source)
    lost, made = [], {}
    for k, path in enumerate(SCALARS):
        x = x.withColumn(f"_bad{k}", ~F.coalesce(grounded(F.col(f"summary.{path}.source_quote")), F.lit(True)))
        node, bad = F.col(f"summary.{path}"), F.col(f"_bad{k}")
        cleared = node.withField("value", F.lit(None).cast("string")).withField("source_quote", F.lit(None).cast("string"))
        made[path] = F.when(bad, cleared).otherwise(node)
        lost.append(F.when(node.isNotNull() & bad, 1).otherwise(0))
    for k, path in enumerate(LISTS):
        items = F.col(f"summary.{path}")
        x = x.withColumn(f"_kept{k}", F.filter(items, lambda i: F.coalesce(grounded(i.source_quote), F.lit(True))))
        made[path] = F.col(f"_kept{k}")
        lost.append(F.coalesce(F.size(F.coalesce(items, F.array())) - F.size(F.coalesce(f"_kept{k}", F.array())), F.lit(0)))

    def rebuilt(at: Column, kind, above: str = "") -> Column:
        fields = []
        for f in kind.fields:
            path = above + f.name
            inner = any(p.startswith(path + ".") for p in made)
            fields.append((made[path] if path in made else rebuilt(at[f.name], f.dataType, path + ".") if inner else at[f.name]).alias(f.name))
        return F.when(at.isNotNull(), F.struct(*fields))

    return x.select("rfp_id", rebuilt(s, x.schema["summary"].dataType).alias("summary"), sum(lost, F.lit(0)).alias("removed"))


def evaluation_criteria(requirements: DataFrame, summaries: DataFrame) -> DataFrame:
    """D-03: rfp_id, pos, criterion: the matrix's criteria first, then the summary's factors."""
    own = requirements.where("category = 'Evaluation Criteria'").select("rfp_id", F.lit(0).alias("part"), F.col("extraction_order").cast("int").alias("at"), F.col("raw_text_content").alias("criterion"))
    factors = summaries.select("rfp_id", F.posexplode("summary.evaluation_factors").alias("at", "f")).where("f.factor IS NOT NULL AND f.factor <> ''")
    detail = F.when(F.coalesce("f.description", F.lit("")) != "", F.concat(F.lit(": "), F.col("f.description"))).otherwise("")
    weight = F.when(F.coalesce("f.importance", F.lit("")) != "", F.concat(F.lit(" (importance: "), F.col("f.importance"), F.lit(")"))).otherwise("")
    told = factors.select("rfp_id", F.lit(1).alias("part"), "at", F.concat("f.factor", detail, weight).alias("criterion"))
    pos = F.row_number().over(W.partitionBy("rfp_id").orderBy("part", "at")) - 1
    return own.union(told).select("rfp_id", pos.alias("pos"), "criterion")


def required_volumes(summary: Column) -> Column:
    """D-04: "name — description" of each volume, without a stray dash."""
    named = F.filter(summary.submission_requirements.required_volumes_or_sections, lambda v: F.coalesce(v["name"], F.lit("")) != "")
    line = lambda v: F.regexp_replace(F.concat(v["name"], F.lit(" — "), F.coalesce(v.description, F.lit(""))), r"^[ —]+|[ —]+$", "")
    return F.coalesce(F.transform(named, line), F.array().cast("array<string>"))


def resolve_outline_refs(plans: DataFrame, requirements: DataFrame) -> DataFrame:
    """J-10: plans (rfp_id, outline_index, title, refs, target_words) -> requirement ids in the order of the refs.

    refs count the document's requirements from 0 by (extraction_order, requirement_id); others are dropped.
    """
    place = F.row_number().over(W.partitionBy("rfp_id").orderBy("extraction_order", "requirement_id")) - 1
    numbered = requirements.select("rfp_id", "requirement_id", place.alias("ref"))
    asked = plans.select("rfp_id", "outline_index", F.posexplode("refs").alias("pos", "ref"))
    found = asked.join(numbered, ["rfp_id", "ref"]).groupBy("rfp_id", "outline_index").agg(F.array_sort(F.collect_list(F.struct("pos", "requirement_id"))).alias("r"))
    kind = dict(requirements.dtypes)["requirement_id"]
    ids = F.coalesce(F.transform("r", lambda s: s.requirement_id), F.array().cast(f"array<{kind}>"))
    return plans.join(found, ["rfp_id", "outline_index"], "left").select("rfp_id", "outline_index", "title", ids.alias("requirement_ids"), F.nullif("target_words", F.lit(0)).alias("target_words"))
