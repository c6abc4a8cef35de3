"""Rules on drafted text, critic verdicts, notes and prompt blocks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderspark.functions.columns import let
from tenderspark.functions.numbers import money_rounded
from tenderspark.functions.text import strip, truncate

# Fixed values.
MIN_CHARS, CHARS_PER_REQUIREMENT, MAX_BANNED, MAX_ATTEMPTS = 20, 150, 3, 3
MAX_CHUNK_CHARS, MAX_SOLICITATION_CHARS, PROMPT_CEILING, TOP_PAST_PERFORMANCE = 1500, 4000, 24_000, 8
PLACEHOLDERS = [
    r"\[insert[^\]]*\]",
    r"\[your[^\]]*\]",
    r"\[company[^\]]*\]",
    r"\[tbd[^\]]*\]",
    r"\bTBD\b",
    r"\bXXX+\b",
    r"\blorem ipsum\b",
    r"<[a-z_ ]*placeholder[a-z_ ]*>",
]
BANNED_PHRASES = [
    "world-class", "world class", "best-in-class", "best in class", "industry-leading", "industry leading", "cutting-edge",
    "cutting edge", "state-of-the-art", "state of the art", "seamless", "leverage synergies", "robust solution",
    "passion for excellence", "trusted partner", "unparalleled",
]
HEADINGS = ["Understanding of the Requirement", "Technical Approach", "Management Plan", "Differentiators"]
CONTRACT_NUMBER = r"\b[A-Z0-9]{5,}-\d{2}-[A-Z]-\d{4,}\b"
DOLLAR_FIGURE = r"\$[\d,]+(?:\.\d+)?"
NO_EVIDENCE = "(no matching past-performance context found)"
CRITIC = (
    "struct<addressed:boolean,evaluation_alignment:boolean,benefit_mapped:boolean,unsupported_claims:array<string>,"
    "filler_found:array<string>,cited_sources:array<string>,feedback:string>"
)
ATTEMPTS = f"array<struct<attempt:int,content_length:int,grounded:boolean,weak_grounding:boolean,guardrail_error:string,draft_error:string,critic:{CRITIC}>>"


def missing_req_tags(text: Column, n: Column) -> Column:
    """F-13: numbers from 1 to n without a tag [Req i] of their own."""
    tagged = F.transform(F.regexp_extract_all(text, F.lit(r"\[Req (\d+)\]"), 1), lambda t: t.try_cast("int"))
    return F.when(n > 0, F.array_except(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), tagged)).otherwise(F.array().cast("array<int>"))


def unverifiable_facts(text: Column, context: Column) -> Column:
    """F-14: contract numbers, then dollar figures, that do not occur in the context."""
    every = F.concat(F.regexp_extract_all(text, F.lit(CONTRACT_NUMBER), 0), F.regexp_extract_all(text, F.lit(DOLLAR_FIGURE), 0))
    return F.filter(every, lambda m: ~F.contains(context, m))


def placeholders_found(text: Column) -> Column:
    """F-15."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in PLACEHOLDERS)))


def banned_phrases(text: Column) -> Column:
    """F-16."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in BANNED_PHRASES))))


def has_required_heading(text: Column) -> Column:
    """F-17."""
    return text.rlike(rf"(?im)^##\s*({'|'.join(HEADINGS)})\b")


def draft_rejection(content: Column, n: Column, headings: Column, tags: Column, context: Column) -> Column:
    """F-18: the first rule that a draft breaks, or null for a usable one."""
    return let(strip(F.coalesce(content, F.lit(""))), lambda t: _rejection(t, n, headings, tags, context))


def _rejection(t: Column, n: Column, headings: Column, tags: Column, context: Column) -> Column:
    size, least = F.length(t), F.greatest(F.lit(MIN_CHARS), n * CHARS_PER_REQUIREMENT)
    return F.coalesce(
        F.when(size < MIN_CHARS, "too_short"),
        F.when(size < least, "too_short_for_requirements"),
        F.when(headings & ~has_required_heading(t), "no_required_heading"),
        F.when(tags & (n > 0) & (F.size(missing_req_tags(t, n)) > 0), "missing_requirement_tags"),
        F.when(context.isNotNull() & (F.size(unverifiable_facts(t, context)) > 0), "unverifiable_facts"),
        F.when(F.size(placeholders_found(t)) > 0, "placeholders"),
        F.when(F.size(banned_phrases(t)) > MAX_BANNED, "filler_heavy"),
    )


def critic_passes(c: Column) -> Column:
    """F-29."""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    return F.coalesce(c.addressed & c.evaluation_alignment & c.benefit_mapped & empty(c.unsupported_claims) & empty(c.filler_found), F.lit(False))


def critic_feedback(c: Column) -> Column:
    """F-30: the critic's findings as one instruction."""
    listed = lambda a, head: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(a, "; ")))
    return F.concat_ws(
        "\n",
        F.nullif(c.feedback, F.lit("")),
        listed(c.unsupported_claims, "Remove or substantiate these unsupported claims: "),
        listed(c.filler_found, "Replace this filler with specific, evidenced content: "),
        F.when(~c.evaluation_alignment, "Speak directly to the stated evaluation criteria."),
        F.when(
            ~c.benefit_mapped,
            "At least one claim states a feature/proof but never the operational benefit to the government — for every substantive "
            "claim, state the benefit explicitly and tie it to a named evaluation criterion when one applies.",
        ),
    )


def combine_feedback(history: Column) -> Column:
    """F-31."""
    many = F.array_join(F.transform(history, lambda f, i: F.concat(F.lit("[Revision "), (i + 1).cast("string"), F.lit(" feedback]\n"), f)), "\n\n")
    return F.when(F.size(history) > 1, many).when(F.size(history) == 1, F.get(history, F.lit(0)))


def review_notes(content: Column, feedback: Column, grounded: Column, n: Column, n_grounded: Column, weak: Column, cited: Column, available: Column) -> Column:
    """F-32: notes for the reviewer, or null."""
    has = F.coalesce(content, F.lit("")) != ""
    yes = F.coalesce(grounded, F.lit(False))
    unused = F.array_sort(F.array_except(available, cited))
    notes = F.concat_ws(
        "\n",
        F.when(has, F.nullif(feedback, F.lit(""))),
        F.when(has & ~yes, "Drafted without matching past-performance context — claims are unevidenced; verify before submission."),
        F.when(
            has & yes & (n > 0) & (n_grounded < n),
            F.concat(
                F.lit("Only "), n_grounded.cast("string"), F.lit("/"), n.cast("string"),
                F.lit(" requirement(s) in this section have supporting past-performance evidence — the rest may rest on unevidenced assumptions; verify before submission."),
            ),
        ),
        F.when(has & yes & weak, "Some evidence used fell below the standard relevance threshold — verify it actually supports the claim before submission."),
        F.when(
            has & yes & (F.size(cited) > 0) & (F.size(unused) > 0),
            F.concat(
                F.lit("Retrieved evidence from "), F.array_join(unused, ", "),
                F.lit(" was supplied but the compliance review found no claim reflecting it — retrieval may be broader than what the draft actually cites."),
            ),
        ),
    )
    return F.nullif(notes, F.lit(""))


def final_status(content: Column, attempts: Column) -> Column:
    """F-33."""
    last = F.try_element_at(attempts, F.lit(-1))
    blocked = F.coalesce(F.coalesce(last.guardrail_error, F.lit("")) != "", F.lit(False))
    return F.when(F.coalesce(content, F.lit("")) != "", "saved").when(blocked, "guardrail_rejected").otherwise("draft_failed")


def section_title_default(section: Column) -> Column:
    """F-40."""
    return F.concat(F.lit("Response to "), F.coalesce(F.nullif(section, F.lit("")), F.lit("requirement")))


def evidence_blocks(hits: Column, limit: int | None = None) -> Column:
    """F-28: array<struct<source_name, score, content>> as text."""
    body = lambda h: truncate(h.content, limit) if limit else h.content
    one = lambda h: F.concat(F.lit("["), h.source_name, F.lit(" — relevance "), F.format_string("%.2f", h.score), F.lit("]\n"), body(h))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, F.array_join(F.transform(hits, one), "\n\n")).otherwise(NO_EVIDENCE)


def top_past_performance(entries: Column, k: int = TOP_PAST_PERFORMANCE) -> Column:
    """W-10: struct<shown, omitted>: entries by value, list order among equals."""
    tagged = F.transform(entries, lambda e, i: F.struct((-F.coalesce(e["value"], F.lit(0.0))).alias("v"), i.alias("i"), e.alias("e")))
    ordered = F.transform(F.array_sort(tagged), lambda t: t.e)
    return F.struct(F.slice(ordered, 1, k).alias("shown"), F.greatest(F.size(entries) - k, F.lit(0)).alias("omitted"))


def company_block(p: Column) -> Column:
    """F-25: prompt lines of a company profile, null when it is empty."""
    named = [
        ("Legal name", p.legal_name),
        ("CAGE code", p.cage_code),
        ("UEI", p.uei_number),
        ("DUNS", p.duns_number),
        ("NAICS", F.concat_ws(" ", F.nullif(p.naics_code, F.lit("")), F.nullif(p.naics_description, F.lit("")))),
        ("Set-aside / socio-economic status", F.array_join(p.socio_economic_status, ", ")),
        ("CMMC level", p.cmmc_level),
        ("Certifications", F.array_join(p.certifications, ", ")),
        ("Facility/personnel clearance", p.security_clearance),
        ("Capabilities", p.capabilities_overview),
    ]
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"- {k}: "), v)) for k, v in named]
    top = top_past_performance(p.past_performance)
    n = F.size(top.shown).cast("string")
    head = F.when(top.omitted > 0, F.concat(F.lit("- Past performance (top "), n, F.lit(" by value):"))).otherwise("- Past performance:")
    entry = lambda e: F.concat(F.lit("    * "), e.contract_number, F.lit(" — "), e.agency, F.lit(", "), money_rounded(e["value"]), F.lit(", "), e.period, F.lit(": "), e.scope)
    past = F.when(F.coalesce(F.size(p.past_performance), F.lit(0)) > 0, F.concat_ws("\n", head, F.array_join(F.transform(top.shown, entry), "\n")))
    return F.nullif(F.concat_ws("\n", *lines, past), F.lit(""))


def solicitation_block(s: Column) -> Column:
    """F-26: prompt lines of a solicitation summary, null when nothing was extracted."""
    a, d, sub, core = s.administrative, s.deadlines, s.submission_requirements, s.technical_core
    named = [
        ("Opportunity", a.title_of_opportunity),
        ("Agency", a.agency_or_organization),
        ("Solicitation #", a.solicitation_number),
        ("NAICS", a.naics_code),
        ("Set-aside", a.set_aside_type),
        ("Primary objective", core.primary_objective),
        ("Proposal due", d.proposal_due_date),
        ("Period of performance", d.period_of_performance),
    ]
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    lines = [F.when(filled(v["value"]), F.concat(F.lit(f"- {k}: "), v["value"])) for k, v in named]
    method = sub.submission_method
    extra = F.when(filled(method.description), F.concat(F.lit(" ("), method.description, F.lit(")"))).otherwise("")
    lines.append(F.when(filled(method["value"]), F.concat(F.lit("- Submission method: "), method["value"], extra)))
    text = lambda c: F.coalesce(c, F.lit("None"))

    def bullets(head, items, key, render):
        kept = F.filter(items, lambda i: filled(i[key]))
        shown = F.array_join(F.transform(kept, lambda i: F.concat(F.lit("    * "), render(i))), "\n")
        return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit(f"- {head}:\n"), shown))

    lines += [
        bullets("Page limits", sub.page_limits, "limit", lambda i: F.concat(text(i.volume), F.lit(": "), i.limit)),
        bullets("Required volumes/sections", sub.required_volumes_or_sections, "name", lambda i: F.concat(i["name"], F.lit(" — "), text(i.description))),
        bullets("Key deliverables", core.key_deliverables, "title", lambda i: F.concat(i.title, F.lit(": "), text(i.description))),
        bullets(
            "Instructions to offerors (Section L)", s.instructions_to_offerors, "instruction",
            lambda i: F.concat(F.lit("["), F.coalesce(F.nullif(i.applies_to, F.lit("")), F.lit("All")), F.lit("] "), i.instruction),
        ),
    ]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def section_prompt(title: Column, requirements: Column, hits: Column, feedback: Column, solicitation: Column, company: Column, criteria: Column, themes: Column, words: Column) -> Column:
    """F-27: struct<prompt, over_ceiling>: background first, what the draft is scored against last."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    dashes = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("  - "), x)), "\n")
    parts = [
        F.when(filled(solicitation), F.concat(F.lit("SOLICITATION CONTEXT:\n"), truncate(solicitation, MAX_SOLICITATION_CHARS), F.lit("\n\n"))),
        F.when(filled(company), F.concat(F.lit("COMPANY PROFILE:\n"), company, F.lit("\n\n"))),
        F.concat(F.lit("PAST-PERFORMANCE CONTEXT:\n"), evidence_blocks(hits, MAX_CHUNK_CHARS), F.lit("\n\n")),
        F.when(some(themes), F.concat(F.lit("WIN THEMES TO CARRY THROUGH THIS SECTION:\n"), dashes(themes), F.lit("\n\n"))),
        F.concat(F.lit("PROPOSAL SECTION: "), title, F.lit("\n\n")),
        F.when(some(criteria), F.concat(F.lit("EVALUATION CRITERIA THIS SECTION IS SCORED ON:\n"), dashes(criteria), F.lit("\n\n"))),
        F.lit("REQUIREMENTS THIS SECTION MUST SATISFY:\n"),
        F.array_join(F.transform(requirements, lambda r, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), r)), "\n"),
        F.lit("\n"),
        F.when(words > 0, F.concat(F.lit("\nTarget length: approximately "), words.cast("string"), F.lit(" words."))),
        F.when(filled(feedback), F.concat(F.lit("\nA prior draft was reviewed and found lacking. Address this feedback specifically:\n"), feedback, F.lit("\n"))),
        F.lit("\n\nWrite the section draft now."),
    ]
    prompt = F.concat_ws("", *parts)
    return F.struct(prompt.alias("prompt"), (F.length(prompt) > PROMPT_CEILING).alias("over_ceiling"))

