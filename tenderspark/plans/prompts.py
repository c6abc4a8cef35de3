"""Queries over extractions: one summary a document, its checked citations, prompt blocks, notes and model calls.

What a model would have returned is made from `conversations`: a turn is a chunk, and each field of its extraction is
one portable expression, used by the query and by its SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions import drafts
from tenderspark.operators import matrix, seams
from tenderspark.operators.memo import Memo
from tenderspark.plans import texts
from tenderspark.plans.registry_tools import Registry
from tenderspark.sources.shared import new_path

R = Registry()

# A quarter of the conversations gives documents of one chunk each.
RFP = "CASE WHEN conv_id % 4 = 0 THEN conv_id * 100 + turn ELSE conv_id * 100 END"
FABRICATED = "concat('Fabricated ', text)"
METHOD = matrix.SCALARS.index("submission_requirements.submission_method")
NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
NAMES = [p.split(".")[-1] for p in [*matrix.SCALARS, *matrix.LISTS]]


def citation(j: int) -> tuple[str, str, str]:
    """Of citation j: whether the chunk has it, its value and its quote."""
    value = f"CASE WHEN (turn + {j}) % 3 <> 0 THEN concat('v{j} ', role, ' ', CAST(turn AS STRING)) END"
    quote = f"CASE WHEN (conv_id + {j}) % 3 <> 0 THEN CASE WHEN (conv_id + turn) % 4 = 0 THEN {FABRICATED} ELSE text END END"
    return f"(turn + {j}) % 7 <> 6", value, quote


def items(m: int) -> list[tuple[str, str, str]]:
    """Of list m: first field, second field and quote of each item."""
    return [
        (f"concat('item ', CAST(turn * {m + 1} % 3 AS STRING))", "role", "text"),
        ("text", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"),
        ("CASE WHEN turn % 2 = 1 THEN 'twice' END", "'z'", FABRICATED),
    ]


def has_list(m: int) -> str:
    return f"(turn + {m}) % 6 <> 5"


def extracted(conversations: DataFrame) -> DataFrame:
    """rfp_id, chunk_idx, summary: what was extracted from each chunk."""
    values = {}
    for j, path in enumerate(matrix.SCALARS):
        has, value, quote = map(F.expr, citation(j))
        values[path] = F.when(has, F.struct(value, *([F.col("role")] if j == METHOD else []), quote))
    for m, path in enumerate(matrix.LISTS):
        more = [F.col("role").alias("c")] if path == "evaluation_factors" else []
        made = [F.struct(F.expr(a).alias("a"), F.expr(b).alias("b"), *more, F.expr(q).alias("q")) for a, b, q in items(m)]
        values[path] = F.when(F.expr(has_list(m)), F.array(*made))
    groups = ("administrative", "deadlines", "submission_requirements", "technical_core")
    nested = [F.struct(*(v for p, v in values.items() if p.startswith(g + "."))) for g in groups]
    summary = F.struct(*nested, values["evaluation_factors"], values["instructions_to_offerors"]).cast(matrix.SUMMARY)
    return conversations.select(F.expr(RFP).alias("rfp_id"), F.col("turn").alias("chunk_idx"), summary.alias("summary"))


def sources(conversations: DataFrame) -> DataFrame:
    """rfp_id, text: the text of a document without every third chunk, whose quotes are so not to be found."""
    kept = conversations.where("turn % 3 <> 1").select(F.expr(RFP).alias("rfp_id"), F.struct("turn", "text").alias("c"))
    return kept.groupBy("rfp_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.text), "\n").alias("text"))


def flat(summaries: DataFrame) -> DataFrame:
    """Summaries with a text column for each field."""
    told = lambda c: F.coalesce(c, F.lit("-"))

    def scalar(path: str) -> Column:
        node = F.col(f"summary.{path}")
        more = [told(node.description)] if path == matrix.SCALARS[METHOD] else []
        return F.concat_ws("~", told(node["value"]), told(node.source_quote), *more)

    def listed(path: str) -> Column:
        kind = summaries.select(f"summary.{path}").schema[0].dataType.elementType
        first, second = kind.names[:2]
        line = lambda x: F.concat_ws("~", told(x[first]), told(x[second]), told(x.source_quote))
        return F.coalesce(F.array_join(F.transform(F.col(f"summary.{path}"), line), "|"), F.lit(""))

    made = [*map(scalar, matrix.SCALARS), *map(listed, matrix.LISTS)]
    return summaries.select("rfp_id", *(c.alias(n) for c, n in zip(made, NAMES, strict=True)), *(c for c in summaries.columns if c not in ("rfp_id", "summary")))


def merged_sql() -> str:
    """CTEs: chunks; m with a struct {v, q, d} for each citation; items (rfp_id, m, turn, i, a, b, q) of the merged lists."""
    nodes = []
    for j in range(len(matrix.SCALARS)):
        has, value, quote = citation(j)
        node = ", ".join(f"'{k}': CASE WHEN {has} THEN {v} END" for k, v in (("v", value), ("q", quote), ("d", "role")))
        nodes.append(f"list({{{node}}} ORDER BY NOT ({has} AND {value} IS NOT NULL), turn)[1] AS s{j}")
    rows = []
    for m in range(len(matrix.LISTS)):
        structs = ", ".join(f"{{'i': {i}, 'a': {a}, 'b': {b}, 'q': {q}}}" for i, (a, b, q) in enumerate(items(m)))
        rows.append(f"SELECT rfp_id, {m} AS m, turn, unnest([{structs}]) AS x FROM chunks WHERE {has_list(m)}")
    return f"""WITH chunks AS (SELECT {RFP} AS rfp_id, * FROM conversations), m AS (SELECT rfp_id, count(*) AS n, {", ".join(nodes)} FROM chunks GROUP BY rfp_id),
        l AS ({" UNION ALL ".join(rows)}),
        k AS (SELECT rfp_id, m, turn, x.i AS i, x.a AS a, x.b AS b, x.q AS q, row_number() OVER (PARTITION BY rfp_id, m, coalesce(x.a, ''), CASE WHEN m = 0 THEN coalesce(x.b, '') END ORDER BY turn, x.i) AS r FROM l),
        items AS (SELECT k.* FROM k JOIN m USING (rfp_id) WHERE r = 1 OR n = 1)"""


def flat_sql(bad: str) -> str:
    """SELECT of the flat columns; `bad` is a test with {0} for a quote, true where its citation is to be cleared."""
    cleared = lambda j, k: f"CASE WHEN {bad.format(f's{j}.q')} THEN NULL ELSE s{j}.{k} END"
    told = lambda c: f"coalesce({c}, '-')"
    columns = []
    for j in range(len(matrix.SCALARS)):
        parts = [told(cleared(j, "v")), told(cleared(j, "q")), *([told(f"s{j}.d")] if j == METHOD else [])]
        columns.append(f"concat_ws('~', {', '.join(parts)}) AS {NAMES[j]}")
    for m in range(len(matrix.LISTS)):
        columns.append(f"coalesce(l{m}, '') AS {NAMES[len(matrix.SCALARS) + m]}")
    return ", ".join(columns)


LISTED = ", ".join(f"string_agg(concat_ws('~', coalesce(a, '-'), coalesce(b, '-'), coalesce(q, '-')), '|' ORDER BY turn, i) FILTER (WHERE m = {m}) AS l{m}" for m in range(len(matrix.LISTS)))
R.add(
    "a18_merge_summaries", ["conversations"], lambda c: flat(matrix.merge_summaries(extracted(c))),
    f"{merged_sql()}, f AS (SELECT rfp_id, {LISTED} FROM items GROUP BY rfp_id) SELECT m.rfp_id, {flat_sql('false')} FROM m LEFT JOIN f ON f.rfp_id = m.rfp_id",
)
BAD = f"coalesce(length({NORM}) >= 40 AND NOT contains(source, {NORM}), false)"
R.add(
    "f12_sanitize_summary", ["conversations"], lambda c: flat(matrix.sanitize_summary(matrix.merge_summaries(extracted(c)), sources(c))),
    f"""{merged_sql()}, src AS (SELECT rfp_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM chunks WHERE turn % 3 <> 1 GROUP BY rfp_id),
        norm AS (SELECT m.*, {NORM.format("coalesce(text, '')")} AS source FROM m LEFT JOIN src USING (rfp_id)), judged AS (SELECT items.*, {BAD.format("q")} AS bad FROM items JOIN norm USING (rfp_id)),
        lost AS (SELECT rfp_id, count(*) FILTER (WHERE bad) AS lost FROM judged GROUP BY rfp_id), f AS (SELECT rfp_id, {LISTED} FROM judged WHERE NOT bad GROUP BY rfp_id)
        SELECT norm.rfp_id, {flat_sql(BAD)}, CAST(coalesce(lost, 0) + {" + ".join(f"CAST({BAD.format(f's{j}.q')} AS INT)" for j in range(len(matrix.SCALARS)))} AS INT) AS removed
        FROM norm LEFT JOIN f ON f.rfp_id = norm.rfp_id LEFT JOIN lost ON lost.rfp_id = norm.rfp_id""",
)
# Place in SCALARS of the prompt's lines, in their order; then list, test and line of each bulleted list.
LINES = {"Opportunity": 1, "Agency": 2, "Solicitation #": 0, "NAICS": 3, "Set-aside": 4, "Primary objective": 9, "Proposal due": 6, "Period of performance": 7}
BULLETS = [
    ("Page limits", 0, "b <> ''", "concat(coalesce(a, 'None'), ': ', b)"), ("Required volumes/sections", 1, "a <> ''", "concat(a, ' — ', coalesce(b, 'None'))"),
    ("Key deliverables", 2, "a <> ''", "concat(a, ': ', coalesce(b, 'None'))"), ("Instructions to offerors (Section L)", 4, "a <> ''", "concat('[', coalesce(nullif(b, ''), 'All'), '] ', a)"),
]
R.add(
    "f26_solicitation_block", ["conversations"],
    lambda c: matrix.merge_summaries(extracted(c)).select("rfp_id", drafts.solicitation_block(F.col("summary")).alias("block"), matrix.required_volumes(F.col("summary")).alias("volumes")),
    f"""{merged_sql()}, f AS (SELECT rfp_id, {", ".join(f"string_agg(concat('    * ', {line}), chr(10) ORDER BY turn, i) FILTER (WHERE m = {m} AND {test}) AS b{m}" for _, m, test, line in BULLETS)},
        list(regexp_replace(concat(a, ' — ', coalesce(b, '')), '^[ —]+|[ —]+$', '', 'g') ORDER BY turn, i) FILTER (WHERE m = 1 AND a <> '') AS volumes FROM items GROUP BY rfp_id)
        SELECT m.rfp_id, nullif(concat_ws(chr(10), {", ".join(f"CASE WHEN s{j}.v <> '' THEN concat('- {k}: ', s{j}.v) END" for k, j in LINES.items())}, CASE WHEN s{METHOD}.v <> '' THEN concat('- Submission method: ', s{METHOD}.v, ' (', s{METHOD}.d, ')') END,
        {", ".join(f"CASE WHEN b{m} IS NOT NULL THEN concat('- {head}:', chr(10), b{m}) END" for head, m, _, _ in BULLETS)}), '') AS block, coalesce(volumes, []) AS volumes FROM m LEFT JOIN f ON f.rfp_id = m.rfp_id""",
)


def profiles(p: DataFrame, s: DataFrame) -> DataFrame:
    entry = F.struct("section_id", F.col("section_title").alias("contract_number"), F.col("status").alias("agency"), (F.col("sort_order") * 1000.0).alias("value"), F.coalesce("status", F.lit("open")).alias("period"), F.col("content").alias("scope"))
    past = s.where("status IS NOT NULL").groupBy("proposal_id").agg(F.array_sort(F.collect_list(entry)).alias("past_performance"))
    own = p.selectExpr(
        "proposal_id", "CASE WHEN proposal_id % 5 <> 0 THEN title END legal_name", "CASE WHEN proposal_id % 3 = 0 THEN '' ELSE 'CAGE1' END cage_code", "solicitation_number uei_number", "CAST(NULL AS STRING) duns_number",
        "CASE WHEN proposal_id % 2 = 0 THEN '541512' END naics_code", "CASE WHEN proposal_id % 3 = 1 THEN agency END naics_description", "CASE WHEN proposal_id % 4 = 0 THEN array() ELSE array('8(a)', status) END socio_economic_status",
        "'' cmmc_level", "array(agency) certifications", "CAST(NULL AS STRING) security_clearance", "CASE WHEN proposal_id % 7 = 0 THEN concat(title, ' does it') END capabilities_overview",
    )
    return own.join(past, "proposal_id", "left")


R.add(
    "f25_company_block", ["proposals", "sections"], lambda p, s: profiles(p, s).select("proposal_id", drafts.company_block(F.struct("*")).alias("block")),
    """WITH n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY proposal_id) AS n FROM sections WHERE status IS NOT NULL WINDOW w AS (PARTITION BY proposal_id ORDER BY sort_order DESC, section_id, section_title, status, content)),
        past AS (SELECT proposal_id, concat(CASE WHEN any_value(n) > 8 THEN '- Past performance (top 8 by value):' ELSE '- Past performance:' END, chr(10),
            string_agg(concat('    * ', section_title, ' — ', status, ', $', format('{:,}', CAST(sort_order * 1000 AS BIGINT)), ', ', status, ': ', content), chr(10) ORDER BY i) FILTER (WHERE i <= 8)) AS past FROM n GROUP BY proposal_id)
        SELECT p.proposal_id, concat_ws(chr(10), CASE WHEN p.proposal_id % 5 <> 0 THEN concat('- Legal name: ', title) END, CASE WHEN p.proposal_id % 3 <> 0 THEN '- CAGE code: CAGE1' END, concat('- UEI: ', solicitation_number),
            CASE WHEN p.proposal_id % 2 = 0 OR p.proposal_id % 3 = 1 THEN concat('- NAICS: ', concat_ws(' ', CASE WHEN p.proposal_id % 2 = 0 THEN '541512' END, CASE WHEN p.proposal_id % 3 = 1 THEN agency END)) END,
            CASE WHEN p.proposal_id % 4 <> 0 THEN concat('- Set-aside / socio-economic status: 8(a), ', status) END, concat('- Certifications: ', agency), CASE WHEN p.proposal_id % 7 = 0 THEN concat('- Capabilities: ', title, ' does it') END, past) AS block
        FROM proposals p LEFT JOIN past ON past.proposal_id = p.proposal_id""",
)


def sections_of(c: DataFrame) -> DataFrame:
    """A section for each conversation: what the user said is required, what the assistant said is evidence."""
    user, turn = F.col("role") == "user", F.struct("turn", F.col("role").alias("source_name"), (F.col("turn") / 4).alias("score"), F.col("text").alias("content"))
    own = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(user, turn))).alias("asked"), F.array_sort(F.collect_list(F.when(~user, turn))).alias("hits"), F.array_sort(F.collect_list(turn)).alias("whole"))
    texts = lambda a: F.transform(a, lambda h: h.content)
    return own.select("conv_id", texts("asked").alias("requirements"), "hits", F.array_join(texts("whole"), "\n").alias("whole"))


def prompts(c: DataFrame) -> DataFrame:
    n, null = F.col("conv_id"), F.lit(None).cast("string")
    made = drafts.section_prompt(
        F.concat(F.lit("Section "), n.cast("string")), F.col("requirements"), F.col("hits"), F.when(n % 3 == 0, "say more"), F.when(n % 4 != 0, F.col("whole")), F.when(n % 5 == 0, "- Legal name: us").otherwise(null),
        F.when(n % 2 == 0, F.array(F.lit("price"), F.lit("staff"))), F.when(n % 7 == 0, F.array(F.lit("speed"))), F.when(n % 3 == 1, 250).otherwise(0),
    )
    return sections_of(c).select("conv_id", made.alias("p")).select("conv_id", "p.*")


CUT = r"CASE WHEN length({0}) <= {1} THEN {0} ELSE concat(regexp_replace(substring({0}, 1, {1}), '\s+$', ''), ' …[truncated]') END"
R.add(
    "f27_section_prompt", ["conversations"], prompts,
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS i, {CUT.format("text", drafts.MAX_CHUNK_CHARS)} AS short FROM conversations),
        s AS (SELECT conv_id AS n, string_agg(concat('  ', i, '. ', text), chr(10) ORDER BY turn) FILTER (WHERE role = 'user') AS asked, string_agg(text, chr(10) ORDER BY turn) AS whole,
            string_agg(concat('[', role, ' — relevance ', format('{{:.2f}}', turn / 4), ']', chr(10), short), concat(chr(10), chr(10)) ORDER BY turn) FILTER (WHERE role <> 'user') AS hits FROM t GROUP BY conv_id),
        p AS (SELECT n AS conv_id, concat(CASE WHEN n % 4 <> 0 AND whole <> '' THEN concat('SOLICITATION CONTEXT:', chr(10), {CUT.format("whole", drafts.MAX_SOLICITATION_CHARS)}, chr(10), chr(10)) END, CASE WHEN n % 5 = 0 THEN concat('COMPANY PROFILE:', chr(10), '- Legal name: us', chr(10), chr(10)) END,
            'PAST-PERFORMANCE CONTEXT:', chr(10), coalesce(hits, '{drafts.NO_EVIDENCE}'), chr(10), chr(10), CASE WHEN n % 7 = 0 THEN concat('WIN THEMES TO CARRY THROUGH THIS SECTION:', chr(10), '  - speed', chr(10), chr(10)) END, 'PROPOSAL SECTION: Section ', n, chr(10), chr(10),
            CASE WHEN n % 2 = 0 THEN concat('EVALUATION CRITERIA THIS SECTION IS SCORED ON:', chr(10), '  - price', chr(10), '  - staff', chr(10), chr(10)) END, 'REQUIREMENTS THIS SECTION MUST SATISFY:', chr(10), coalesce(asked, ''), chr(10),
            CASE WHEN n % 3 = 1 THEN concat(chr(10), 'Target length: approximately 250 words.') END, CASE WHEN n % 3 = 0 THEN concat(chr(10), 'A prior draft was reviewed and found lacking. Address this feedback specifically:', chr(10), 'say more', chr(10)) END,
            chr(10), chr(10), 'Write the section draft now.') AS prompt FROM s)
        SELECT conv_id, prompt, length(prompt) > {drafts.PROMPT_CEILING} AS over_ceiling FROM p""",
)


def reviewed(c: DataFrame) -> DataFrame:
    t, n, error = F.col("turn"), F.col("conv_id"), F.lit(None).cast("string")
    content = F.when((n + t) % 5 != 0, F.col("text")).when(t % 2 == 0, "")
    both = F.array(F.lit("user"), F.col("role"))
    notes = drafts.review_notes(content, F.when(t % 3 == 0, "fix").when(t % 3 == 1, ""), F.when(t % 4 != 3, t % 4 != 0), n % 4, t % 3, t % 2 == 0, F.when(n % 3 != 0, F.array("role")).otherwise(F.array().cast("array<string>")), F.array_union(both, F.array(F.lit("appendix"))))
    attempt = F.struct(F.lit("first").alias("guardrail_error")), F.struct(F.when(n % 2 == 0, "placeholders").when(n % 3 == 0, "").otherwise(error).alias("guardrail_error"))
    tried = F.when(t % 6 != 5, F.array(*attempt)).otherwise(F.array(attempt[0]))
    return c.select("conv_id", "turn", notes.alias("notes"), drafts.final_status(content, tried).alias("status"))


R.add(
    "f32_review_notes", ["conversations"], reviewed,
    """WITH x AS (SELECT *, CASE WHEN (conv_id + turn) % 5 <> 0 THEN text WHEN turn % 2 = 0 THEN '' END AS content, turn % 4 <> 3 AND turn % 4 <> 0 AS grounded, conv_id % 4 AS n, turn % 3 AS g,
            list_sort(list_filter(list_distinct(['user', role, 'appendix']), lambda r: conv_id % 3 = 0 OR r <> role)) AS unused FROM conversations), y AS (SELECT *, coalesce(content, '') <> '' AS has FROM x)
        SELECT conv_id, turn, nullif(concat_ws(chr(10), CASE WHEN has AND turn % 3 = 0 THEN 'fix' END, CASE WHEN has AND NOT grounded THEN 'Drafted without matching past-performance context — claims are unevidenced; verify before submission.' END,
            CASE WHEN has AND grounded AND n > 0 AND g < n THEN concat('Only ', g, '/', n, ' requirement(s) in this section have supporting past-performance evidence — the rest may rest on unevidenced assumptions; verify before submission.') END,
            CASE WHEN has AND grounded AND turn % 2 = 0 THEN 'Some evidence used fell below the standard relevance threshold — verify it actually supports the claim before submission.' END,
            CASE WHEN has AND grounded AND conv_id % 3 <> 0 AND len(unused) > 0 THEN concat('Retrieved evidence from ', list_aggregate(unused, 'string_agg', ', '), ' was supplied but the compliance review found no claim reflecting it — retrieval may be broader than what the draft actually cites.') END), '') AS notes,
            CASE WHEN has THEN 'saved' WHEN turn % 6 = 5 OR conv_id % 2 = 0 THEN 'guardrail_rejected' ELSE 'draft_failed' END AS status FROM y""",
)


# Model calls, by functions that stand for a model: what they return can be said in SQL.
def question(texts: list[str]) -> list[str]:
    if any("1-URGENT" in t for t in texts):
        raise ValueError("refused")
    return ["" if t.startswith("Security") else t.upper() for t in texts]


R.add(
    "d05_distinct_inference", ["requirements"], lambda r: seams.distinct_before_inference(r.select("requirement_id", F.col("category").alias("title"), F.col("raw_text_content").alias("requirement")), question),
    r"""WITH p AS (SELECT requirement_id, category AS title, raw_text_content AS requirement, concat(category, chr(10), raw_text_content) AS plain FROM requirements)
        SELECT requirement_id, title, requirement, concat('hyde:', substring(sha256(plain), 1, 24)) AS hyde_key, CASE WHEN contains(plain, '1-URGENT') OR starts_with(plain, 'Security') THEN plain ELSE upper(plain) END AS query FROM p""",
)


def lengths(texts: list[str]) -> list[list[float]]:
    """A vector of four numbers of which one, the text's length, is not 0."""
    return [[float(len(t)) if k == len(t) % 4 else 0.0 for k in range(4)] for t in texts]


R.add(
    "i01_embed_chunks", ["documents"], lambda d: seams.embed_chunks(d.select("doc_id", F.coalesce("text", F.lit("")).alias("content")), lengths, 4).select("doc_id", "embedding"),
    "SELECT doc_id, [CASE WHEN length(coalesce(text, '')) > 0 AND length(coalesce(text, '')) % 4 = k THEN 1.0::FLOAT ELSE 0.0::FLOAT END FOR k IN range(4)] AS embedding FROM documents",
)


def sentences(texts: list[str]) -> list[list[dict]]:
    """A requirement for each line of a chunk."""
    return [[{"section_number": " L.1 ", "raw_text_content": line, "category": "Technical", "search_keywords": [line]} for line in t.split("\n")] for t in texts]


R.add(
    "i02_extract_requirements", ["conversations"],
    lambda c: seams.extract_requirements(c.selectExpr("conv_id rfp_id", "turn chunk_idx", "text chunk"), sentences, ["Technical"]).select("rfp_id", "extraction_order", "section_number", "raw_text_content", "category"),
    r"""WITH l AS (SELECT conv_id AS rfp_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
        o AS (SELECT rfp_id, row_number() OVER (PARTITION BY rfp_id ORDER BY turn, i) - 1 AS extraction_order, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
        c AS (SELECT rfp_id, extraction_order, CASE WHEN length(line) > 4000 THEN regexp_replace(substring(line, 1, 4000), '\s+$', '') ELSE line END AS raw_text_content FROM o)
        SELECT rfp_id, extraction_order, 'L.1' AS section_number, raw_text_content, 'Technical' AS category FROM c WHERE length(raw_text_content) >= 5 QUALIFY row_number() OVER (PARTITION BY rfp_id, lower(raw_text_content) ORDER BY extraction_order) = 1""",
)


def parsed(texts: list[str]) -> list[dict]:
    """The summary that a chunk tells as JSON."""
    return [json.loads(t) for t in texts]


def summarised(c: DataFrame) -> DataFrame:
    memo = Memo(new_path(c.sparkSession, "memo"), "model", "1", matrix.SUMMARY)
    chunks = extracted(c).withColumn("chunk", F.to_json("summary", {"ignoreNullFields": "false"}))
    return flat(seams.extract_summaries(chunks, parsed, sources(c), memo))


R.add("i03_extract_summaries", ["conversations"], summarised, R.oracles["f12_sanitize_summary"])


def library(d: DataFrame) -> DataFrame:
    memo = Memo(new_path(d.sparkSession, "memo"), "model", "1", "array<float>")
    docs = d.select(F.col("doc_id").alias("proposal_id"), F.col("lang").alias("tenant"), F.col("source").alias("source_name"), texts.one_line().alias("text"))
    return seams.build_library(docs, lengths, 4, memo).select("proposal_id", "chunk_idx", "chunk_id", "embedding")


R.add(
    "i04_build_library", ["documents"], library,
    f"""WITH c AS (SELECT doc_id AS proposal_id, chunk_idx, chunk FROM ({texts.R.oracles["f03_history_chunks"]}) x)
        SELECT proposal_id, chunk_idx, sha256(concat_ws(chr(31), lang, CAST(proposal_id AS VARCHAR), source, CAST(chunk_idx AS VARCHAR), chunk)) AS chunk_id,
        [CASE WHEN length(chunk) % 4 = k THEN 1.0::FLOAT ELSE 0.0::FLOAT END FOR k IN range(4)] AS embedding FROM c JOIN documents ON doc_id = proposal_id""",
)


def drafted(prompts: list[str]) -> list[str]:
    """The prompt itself; a model that fails where it is asked for superlatives."""
    if any("seamless world-class" in p for p in prompts):
        raise RuntimeError("no answer")
    return prompts


R.add(
    "i05_score_drafts", ["documents"],
    lambda d: seams.score_drafts(texts.drafts_of(d).selectExpr("doc_id section_id", "content prompt", "n requirement_count", "headings require_headings", "tags require_tags", "context source_context"), drafted, Memo(new_path(d.sparkSession, "memo"), "model", "1", "string"))
    .select("section_id", "rejection", "final_status", F.sha2("content", 256).alias("content")),
    f"""WITH r AS (SELECT doc_id AS section_id, CASE WHEN contains({texts.DRAFT}, 'seamless world-class') THEN 'draft_failed' ELSE rejection END AS rejection, {texts.DRAFT} AS draft FROM ({texts.R.oracles["f18_draft_rules"]}) x JOIN documents USING (doc_id))
        SELECT section_id, rejection, CASE WHEN rejection IS NULL THEN 'saved' WHEN rejection = 'draft_failed' THEN rejection ELSE 'guardrail_rejected' END AS final_status,
        CASE WHEN rejection IS NULL THEN sha256({texts.STRIP.format("draft")}) END AS content FROM r""",
)


def memo_runs(c: DataFrame) -> DataFrame:
    """Three runs over one memo: the user's turns, all turns, all turns again; how many inputs each had to call for."""
    spark = c.sparkSession
    memo = Memo(new_path(spark, "memo"), "model", "1", "array<float>", round_rows=500)
    call = lambda rows: seams.call_batches(rows, lengths, "text", "value", "array<float>")
    runs = [("first", c.where("role = 'user'")), ("all", c), ("again", c)]
    rows = [(name, memo.fill(part, "text", call)) for name, part in runs]
    kept = memo.known(spark).select(F.lit("kept").alias("run"), F.lit(1).alias("one")).groupBy("run").agg(F.sum("one").alias("calls"))
    return spark.createDataFrame(rows, "run string, calls long").unionByName(kept)


R.add(
    "d05_memo_runs", ["conversations"], memo_runs,
    """WITH t AS (SELECT coalesce(text, '') AS text, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS early FROM conversations GROUP BY 1)
        SELECT unnest(['first', 'all', 'again', 'kept']) AS run, unnest([sum(early)::BIGINT, sum(1 - early)::BIGINT, 0, count(*)]) AS calls FROM t""",
)
