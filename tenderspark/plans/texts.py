"""Queries over texts: columns, chunks, quality, drafts and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderspark.functions import drafts, numbers, text
from tenderspark.operators import chunking, retrieval, rollups
from tenderspark.plans.registry_tools import Registry
from tenderspark.sources import tables

R = Registry()

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


def text_columns(docs):
    t = F.col("text")
    return docs.select(
        "doc_id", text.word_count(t).alias("words"), F.length(text.strip(t)).alias("stripped"), text.normalize_ws(t).alias("normal"), text.truncate(t, 100).alias("short"),
        text.guard_input(t, 500).truncated.alias("truncated"), text.failure_reason(F.col("source"), t).alias("reason"),
        text.strip_requirement_tags(F.concat(t, F.lit(" [Req 1, Req 2, 3] x [req 4]"))).alias("untagged"),
    )


R.add(
    "f10_text_columns", ["documents"], text_columns,
    f"""SELECT doc_id, CAST(len({WORDS.format("text")}) AS INT) AS words, CAST(length({STRIP.format("text")}) AS INT) AS stripped, {NORM.format("text")} AS normal,
        CASE WHEN length(text) <= 100 THEN text ELSE concat(regexp_replace(substring(text, 1, 100), '\\s+$', ''), ' …[truncated]') END AS short, length(text) > 500 AS truncated,
        CASE WHEN length(f) <= 500 THEN f ELSE concat(substring(f, 1, 500), '…') END AS reason, regexp_replace(concat(text, ' [Req 1, Req 2, 3] x [req 4]'), '\\s*\\[Req\\s+\\d+(?:\\s*,\\s*(?:Req\\s+)?\\d+)*\\]', '', 'gi') AS untagged
        FROM (SELECT *, CASE WHEN {STRIP.format("text")} = '' THEN source ELSE concat(source, ': ', {STRIP.format("text")}) END AS f FROM documents) d""",
)
R.add(
    "f06_text_quality", ["documents"],
    lambda d: d.select("doc_id", text.text_quality_ok(F.col("text")).alias("ok"), text.text_quality_ok(F.substring("text", 1, 9)).alias("short_ok"), text.text_quality_ok(F.regexp_replace("text", "[aeiou]", "§")).alias("noisy_ok")),
    r"""WITH t AS (SELECT doc_id, unnest([text, substring(text, 1, 9), regexp_replace(text, '[aeiou]', '§', 'g')]) AS t, unnest([1, 2, 3]) AS k FROM documents), s AS (SELECT doc_id, k, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM t),
        q AS (SELECT doc_id, k, length(t) >= 10 AND length(regexp_replace(t, '[\p{L}\p{N} \n\t.,;:!?()\[\]{}"''\-/%$&@#*+=<>|\\_~\^`]', '', 'g')) / length(t) <= 0.35::DOUBLE AS ok FROM s)
        SELECT doc_id, coalesce(bool_or(ok) FILTER (WHERE k = 1), false) AS ok, coalesce(bool_or(ok) FILTER (WHERE k = 2), false) AS short_ok, coalesce(bool_or(ok) FILTER (WHERE k = 3), false) AS noisy_ok FROM q GROUP BY doc_id""",
)
R.add(
    "a17_text_quality_metrics", ["documents"], lambda d: rollups.text_quality_metrics(d.withColumn("pages", F.lit(5))),
    rf"""WITH w AS (SELECT doc_id, text, {WORDS.format("text")} AS w FROM documents), b AS (SELECT *, list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda x: x <> '') AS b FROM w)
        SELECT doc_id, CAST(len(w) AS INT) AS words, coalesce(round_even(len(list_distinct(b)) / nullif(len(b), 0), 4), 0) AS unique_ratio, round_even(len(w) / 5, 4) AS words_per_page,
        coalesce(round_even(length(regexp_replace(text, '[\p{{L}}\s]', '', 'g')) / nullif(length(text), 0), 4), 0) AS noise_ratio FROM b""",
)
HEADING = r"""{0} <> '' AND length({0}) <= 120 AND (regexp_matches({0}, '^#{{1,6}}\s+\S') OR regexp_matches({0}, '(?i)^(SECTION|PART|VOLUME|ATTACHMENT|APPENDIX|ANNEX)\s+[A-Z0-9]')
        OR regexp_matches({0}, '^([A-Z]{{1,3}}(\.\d+){{0,4}}|\d+(\.\d+){{0,4}})[.)]?\s{{1,4}}[A-Z][A-Za-z0-9 ,/&()''-]{{2,90}}$') OR (length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= 3 AND upper({0}) = {0} AND length({0}) <= 90))"""
R.add(
    "f01_heading_lines", ["documents"],
    lambda d: d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(text.is_heading(F.col("line"))),
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), t AS (SELECT *, {STRIP.format("line")} AS s FROM l)
        SELECT doc_id, line_no, line FROM t WHERE {HEADING.format("s")}""",
)
LINES = r"'\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'"


def pack_sql(name: str, items: str, limit: int) -> str:
    """CTEs: `items` (doc_id, sec, n from 1, alone, x) with the number g of the pack that each falls into."""
    more = f"(i.alone OR held = 0 OR held + 2 + length(i.x) > {limit})"
    return f"""{name}(doc_id, sec, n, g, held) AS (SELECT doc_id, sec, n, 1, CASE WHEN alone THEN 0 ELSE length(x) END FROM {items} WHERE n = 1
            UNION ALL SELECT i.doc_id, i.sec, i.n, CASE WHEN {more} THEN g + 1 ELSE g END, CASE WHEN i.alone THEN 0 WHEN {more} THEN length(i.x) ELSE held + 2 + length(i.x) END
            FROM {name} p JOIN {items} i ON i.doc_id = p.doc_id AND i.sec = p.sec AND i.n = p.n + 1)"""


def chunks_sql(docs: str, target: int, most: int) -> str:
    """doc_id, chunk_idx, chunk of the texts of `docs` (doc_id, text)."""
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, {STRIP.format("text")} AS t FROM ({docs}) d), a AS (SELECT doc_id, regexp_split_to_array(t, {LINES}) AS a FROM t WHERE length(t) > {most}),
        l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM a), h AS (SELECT *, {STRIP.format("line")} AS s FROM l),
        o AS (SELECT *, sum(CASE WHEN i > 1 AND {HEADING.format("s")} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
        u AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY i) AS u FROM o GROUP BY ALL), v AS (SELECT doc_id, sec, {STRIP.format("u")} AS v FROM u),
        w AS (SELECT doc_id, sec, CASE WHEN length(v) > {most} THEN regexp_split_to_array(v, '\n\s*\n') ELSE [v] END AS w FROM v WHERE v <> ''), p AS (SELECT doc_id, sec, unnest(w) AS p, generate_subscripts(w, 1) AS j FROM w),
        q AS (SELECT *, length(p) > {most} AS alone, unnest(range(0, greatest(1, CAST(ceil(length(p) / {most}) AS BIGINT)))) AS k FROM p),
        items AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY j, k) AS n, alone, CASE WHEN alone THEN substring(p, k * {most} + 1, {most}) ELSE p END AS x FROM q),
        {pack_sql("inner_packs", "items", most)}, pieces AS (SELECT doc_id, sec, g, string_agg(x, chr(10) || chr(10) ORDER BY n) AS x FROM inner_packs JOIN items USING (doc_id, sec, n) GROUP BY ALL),
        outer_items AS (SELECT doc_id, 0 AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY sec, g) AS n, false AS alone, x FROM pieces), {pack_sql("packs", "outer_items", target)}
        SELECT doc_id, CAST(g - 1 AS INT) AS chunk_idx, string_agg(x, chr(10) || chr(10) ORDER BY n) AS chunk FROM packs JOIN outer_items USING (doc_id, sec, n) GROUP BY doc_id, g
        UNION ALL SELECT doc_id, 0, t FROM t WHERE t <> '' AND length(t) <= {most}"""


#: Every other document gets blank lines and headings between its sentences.
SECTIONED = "CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(replace(text, '. ', concat('.', chr(10), ' ', chr(10))), 'and', concat('and', chr(10), 'SECTION L is', chr(10))) END"
R.add(
    "f02_semantic_chunks", ["documents"], lambda d: chunking.chunk_rows(d.selectExpr("doc_id", f"{SECTIONED} AS text"), chunking.semantic_chunks(F.col("text"), 900, 1000)),
    chunks_sql(f"SELECT doc_id, {SECTIONED} AS text FROM documents", 900, 1000),
)
def one_line() -> Column:
    """`text` without a line that could be a heading."""
    return F.lower(F.regexp_replace("text", r"[\r\n\x0b\x0c\x1c-\x1e\x85  #]", " "))


R.add(
    "f03_history_chunks", ["documents"], lambda d: chunking.chunk_rows(d.select("doc_id", one_line().alias("text")), chunking.history_chunks(F.col("text"))),
    r"""WITH t AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[\r\n\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}#]', ' ', 'g')), '^\s+|\s+$', '', 'g') AS t FROM documents),
        n AS (SELECT *, length(t) AS len, CASE WHEN length(t) <= 1200 THEN 1 ELSE CAST(ceil(length(t) / 1050) AS BIGINT) END AS n FROM t WHERE t <> ''),
        m AS (SELECT *, n > 1 AND 2 * (len - (n - 1) * 1050) + 1052 <= 1200 AS short_end FROM n), -- a short last piece joins the one before
        c AS (SELECT *, unnest(range(0, CASE WHEN short_end THEN n - 1 ELSE n END)) AS i FROM m)
        SELECT doc_id, CAST(i AS INT) AS chunk_idx, concat(substring(t, i * 1050 + 1, 1200), CASE WHEN short_end AND i = n - 2 THEN concat(chr(10), chr(10), substring(t, (n - 1) * 1050 + 1, 1200)) ELSE '' END) AS chunk FROM c""",
)
R.add(
    "f04_extraction_chunks", ["documents"], lambda d: chunking.chunk_rows(d.selectExpr("doc_id", f"{SECTIONED} AS text"), chunking.extraction_chunks(F.col("text"), 8000)),
    f"""SELECT doc_id, chunk_idx, chunk FROM ({chunks_sql(f"SELECT doc_id, {SECTIONED} AS text FROM documents WHERE length({SECTIONED}) > 8000", 2000, 4000)}) c
        UNION ALL SELECT doc_id, 0, {SECTIONED} FROM documents WHERE text <> '' AND length({SECTIONED}) <= 8000""",
)
R.add(
    "f07_choose_page_text", ["pages", "documents"],
    lambda p, d: p.join(d, p.page_id == d.doc_id).select("page_id", text.choose_page_text(F.col("html"), F.col("text")).alias("text")),
    r"""WITH x AS (SELECT page_id, html AS page, text AS ocr FROM pages JOIN documents ON page_id = doc_id), s AS (SELECT *, regexp_replace(page, '^\s+|\s+$', '', 'g') AS a, regexp_replace(ocr, '^\s+|\s+$', '', 'g') AS b FROM x)
        SELECT page_id, CASE WHEN length(a) < 20 AND length(b) > length(a) AND length(b) >= 10 AND length(regexp_replace(b, '[\p{L}\p{N} \n\t.,;:!?()\[\]{}"''\-/%$&@#*+=<>|\\_~\^`]', '', 'g')) / length(b) <= 0.35::DOUBLE THEN ocr ELSE page END AS text FROM s""",
)
R.add(
    "f08_assemble_pages", ["conversations"], lambda c: tables.assemble_pages(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(F.col("turn") % 3 == 1, " \n\t ").otherwise(F.col("text")).alias("text"))),
    r"SELECT conv_id AS doc_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY turn, text) AS text FROM conversations WHERE turn % 3 <> 1 AND regexp_matches(text, '\S') GROUP BY conv_id",
)
R.add(
    "f09_markdown_table", ["conversations"],
    lambda c: c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.array("role", "text")).otherwise(F.array(F.lit(" a|b "))).alias("r")))), lambda s: s.r).alias("rows")).select("conv_id", text.markdown_table(F.col("rows")).alias("table")),
    rf"""WITH l AS (SELECT *, bool_or(turn % 2 = 0) OVER (PARTITION BY conv_id) AS two, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        m AS (SELECT *, CASE WHEN turn % 2 = 0 THEN concat('| ', role, ' | ', replace(replace({STRIP.format("coalesce(text, '')")}, chr(10), ' '), '|', '\|'), ' |') WHEN two THEN '| a\|b |  |' ELSE '| a\|b |' END AS line FROM l)
        SELECT conv_id, string_agg(concat(line, CASE WHEN i = 1 THEN concat(chr(10), CASE WHEN two THEN '| --- | --- |' ELSE '| --- |' END) ELSE '' END), chr(10) ORDER BY i) AS table FROM m GROUP BY conv_id""",
)
R.add(
    "f28_evidence_blocks", ["conversations"],
    lambda c: c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("source_name"), (F.col("turn") / 4).alias("score"), F.col("text").alias("content")))).alias("hits")).select("conv_id", drafts.evidence_blocks(F.col("hits")).alias("evidence")),
    "SELECT conv_id, string_agg(concat('[', role, ' — relevance ', format('{:.2f}', turn / 4), ']', chr(10), text), concat(chr(10), chr(10)) ORDER BY turn) AS evidence FROM conversations GROUP BY conv_id",
)
R.add(
    "f11_quote_grounded", ["benchmark", "documents"],
    retrieval.grounded_quotes,
    f"""WITH q AS (SELECT DISTINCT item_id, {NORM.format("coalesce(text, '')")} AS quote FROM benchmark), s AS (SELECT doc_id, {NORM.format("coalesce(text, '')")} AS source FROM documents),
        hits AS (SELECT DISTINCT doc_id, item_id FROM s JOIN q ON length(quote) >= 40 AND contains(source, quote))
        SELECT doc_id, item_id, true AS grounded FROM hits UNION ALL SELECT NULL, item_id, length(quote) < 40 FROM q WHERE item_id NOT IN (SELECT item_id FROM hits)""",
)
DRAFT = "concat(CASE WHEN doc_id % 4 = 0 THEN '## Technical Approach ' ELSE '' END, text, CASE WHEN doc_id % 3 = 0 THEN ' [Req 1] [Req 2]' ELSE ' [Req 1]' END, CASE WHEN doc_id % 7 = 0 THEN ' [INSERT name]' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN ' W91QUZ-19-C-0042 for $4,200,000.50' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN ' seamless world-class unparalleled trusted partner' ELSE '' END)"


def drafts_of(docs):
    return docs.selectExpr("doc_id", f"{DRAFT} AS content", "CAST(doc_id % 3 AS INT) AS n", "doc_id % 8 < 4 AS headings", "doc_id % 2 = 0 AS tags", "CASE WHEN doc_id % 10 = 0 THEN 'W91QUZ-19-C-0042' WHEN doc_id % 10 = 5 THEN NULL ELSE '' END AS context")


def draft_rules(docs):
    x = drafts_of(docs)
    c, t = F.col, F.col("content")
    return x.select(
        "doc_id", drafts.missing_req_tags(t, c("n")).alias("missing"), F.size(drafts.unverifiable_facts(t, F.coalesce(c("context"), F.lit("")))).alias("unverifiable"), F.size(drafts.placeholders_found(t)).alias("placeholders"),
        F.size(drafts.banned_phrases(t)).alias("banned"), drafts.has_required_heading(t).alias("heading"), drafts.draft_rejection(t, c("n"), c("headings"), c("tags"), c("context")).alias("rejection"),
    )


R.add(
    "f18_draft_rules", ["documents"], draft_rules,
    rf"""WITH x AS (SELECT doc_id, {DRAFT} AS t, doc_id % 3 AS n, doc_id % 8 < 4 AS headings, doc_id % 2 = 0 AS tags, CASE WHEN doc_id % 10 = 0 THEN 'W91QUZ-19-C-0042' WHEN doc_id % 10 = 5 THEN NULL ELSE '' END AS context FROM documents),
        y AS (SELECT *, [CAST(i AS INT) FOR i IN range(1, n + 1) IF NOT contains(t, concat('[Req ', i, ']'))] AS missing,
            len(list_filter(list_concat(regexp_extract_all(t, '\b[A-Z0-9]{{5,}}-\d{{2}}-[A-Z]-\d{{4,}}\b'), regexp_extract_all(t, '\$[\d,]+(?:\.\d+)?')), lambda m: NOT contains(coalesce(context, ''), m))) AS unverifiable,
            len(list_filter(['\[insert[^\]]*\]', '\[your[^\]]*\]', '\[company[^\]]*\]', '\[tbd[^\]]*\]', '\bTBD\b', '\bXXX+\b', '\blorem ipsum\b', '<[a-z_ ]*placeholder[a-z_ ]*>'], lambda p: regexp_matches(t, concat('(?i)', p)))) AS placeholders,
            len(list_filter(['world-class','world class','best-in-class','best in class','industry-leading','industry leading','cutting-edge','cutting edge','state-of-the-art','state of the art','seamless','leverage synergies','robust solution','passion for excellence','trusted partner','unparalleled'], lambda p: contains(lower(t), p))) AS banned,
            regexp_matches(t, '(?im)^##\s*(Understanding of the Requirement|Technical Approach|Management Plan|Differentiators)\b') AS heading, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS size FROM x)
        SELECT doc_id, missing, unverifiable, placeholders, banned, heading, CASE WHEN size < 20 THEN 'too_short' WHEN size < n * 150 THEN 'too_short_for_requirements' WHEN headings AND NOT heading THEN 'no_required_heading'
            WHEN tags AND n > 0 AND len(missing) > 0 THEN 'missing_requirement_tags' WHEN context IS NOT NULL AND unverifiable > 0 THEN 'unverifiable_facts' WHEN placeholders > 0 THEN 'placeholders' WHEN banned > 3 THEN 'filler_heavy' END AS rejection FROM y""",
)
MARKED = ("## Head\n- a **b**\n", "\n\n  technical approach \nManagement Plan\nwe do **it** **so**\nTechnical Approach\n####### no\n* last")
R.add(
    "f20_markdown_blocks", ["documents"], lambda d: d.select("doc_id", chunking.markdown_to_text(chunking.parse_markdown(F.concat(F.lit(MARKED[0]), F.col("text"), F.lit(MARKED[1])))).alias("plain")),
    rf"""WITH d AS (SELECT doc_id, string_split('{MARKED[0]}' || text || '{MARKED[1]}', chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, {STRIP.format("unnest(lines)")} AS line FROM d),
        k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}} \s*\S') THEN 'heading' WHEN regexp_matches(line, '^[-*] \s*\S') THEN 'bullet' WHEN line = '' THEN 'blank'
            WHEN lower(line) IN ({", ".join(f"'{h.lower()}'" for h in drafts.HEADINGS)}) THEN 'title' ELSE 'text' END AS kind FROM l),
        o AS (SELECT *, last_value(CASE WHEN kind <> 'title' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
        p AS (SELECT *, kind = 'text' OR (kind = 'title' AND coalesce(before = 'text', false)) AS held FROM o), q AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY doc_id ORDER BY i), false) AS open FROM p),
        b AS (SELECT *, sum(CASE WHEN kind = 'blank' OR (held AND open) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM q),
        t AS (SELECT doc_id, block, string_agg(CASE kind WHEN 'heading' THEN regexp_replace(line, '^#+\s+', '') WHEN 'bullet' THEN concat('• ', regexp_replace(line, '^[-*]\s+', '')) ELSE line END, ' ' ORDER BY i) AS text FROM b WHERE kind <> 'blank' GROUP BY ALL),
        f AS (SELECT doc_id, string_agg(regexp_replace(text, '\*\*(.+?)\*\*', '\1', 'g'), chr(10) ORDER BY block) AS plain FROM t GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(plain, '') AS plain FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id""",
)
R.add(
    "f24_upload_checks", ["documents", "pages"],
    lambda d, p: d.select("doc_id", F.concat("source", F.element_at(F.array(F.lit(".PDF"), F.lit(".docx"), F.lit(".exe"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("name"), (F.col("doc_id") % 5 * 20_000_000).alias("size"), F.encode("text", "UTF-8").alias("content")).select(
        "doc_id", tables.upload_problem(F.col("name"), F.col("size")).alias("problem"), tables.sniff_pdf(F.col("content")).alias("is_pdf"), tables.content_digest(F.col("content")).alias("digest")),
    "SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN 'unsupported' WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 * 20000000 > 52428800 THEN 'too_large' END AS problem, contains(substring(text, 1, 1024), '%PDF-') AS is_pdf, sha256(text) AS digest FROM documents",
)
R.add("s09_proposal_markdown", ["proposals", "sections"], lambda p, s: tables.proposal_markdown(p.withColumn("subtitle", F.nullif("agency", F.lit("BUILDING"))), s.withColumn("content", F.trim("content"))),
    r"""WITH s AS (SELECT proposal_id, string_agg(concat('## ', section_title, chr(10), chr(10), CASE WHEN trim(content) = '' THEN '(no content)' ELSE trim(content) END, chr(10)), chr(10) ORDER BY sort_order, section_id, trim(content)) AS s FROM sections GROUP BY 1)
        SELECT p.proposal_id, concat_ws(chr(10), concat('# ', title, chr(10)), CASE WHEN agency <> 'BUILDING' THEN concat('_', agency, '_', chr(10)) END, s) AS markdown FROM proposals p LEFT JOIN s ON s.proposal_id = p.proposal_id""")  # fmt: skip
R.add("s10_delete_source", ["sections"], lambda s: tables.delete_source(s.selectExpr("section_id", "sort_order tenant", "section_title source_name", "requirement_id % 5 proposal_id"), s.sparkSession.createDataFrame([(3, "Section 3", None), (2, "Section 2", 1)], "tenant int, source_name string, proposal_id long")),
    "SELECT section_id, sort_order AS tenant, section_title AS source_name, requirement_id % 5 AS proposal_id FROM sections WHERE NOT (sort_order = 3 AND requirement_id IS NULL) AND NOT (sort_order = 2 AND requirement_id % 5 IS NOT DISTINCT FROM 1)")
R.add("s11_cascade_delete", ["sections"], lambda s: tables.cascade_delete(s.selectExpr("section_id", "requirement_id proposal_id"), s.where("sort_order = 1").selectExpr("requirement_id proposal_id")),
    "SELECT section_id, requirement_id AS proposal_id FROM sections s WHERE NOT EXISTS (SELECT 1 FROM sections x WHERE x.sort_order = 1 AND x.requirement_id = s.requirement_id)")
R.add("f35_unit_vectors", ["embeddings"], lambda e: e.select("vec_id", numbers.unit_vector(F.transform("embedding", lambda x: x * 3)).alias("u"), "embedding").select("vec_id", F.round(numbers.norm(F.col("u")), 6).alias("norm"), F.round(numbers.cosine(F.col("u"), F.col("embedding")), 6).alias("cosine"), F.round(F.abs(F.get("u", F.lit(0))), 3).alias("first")),
    "SELECT vec_id, 1.0 AS norm, 1.0 AS cosine, round(abs(embedding[1]::DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 3) AS first FROM embeddings")
