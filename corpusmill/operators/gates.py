"""Whether there is evidence enough to answer, and whether an answer keeps to its evidence: decisions with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.queries import same_reference

#: Labels that rule an answer out, statuses that are no evidence, assessments that ask for restraint.
ABSENT = ("absent", "unanswerable", "unknown")
INACTIVE = ("candidate", "quarantine", "superseded", "archived", "revoked", "expired", "conflict")
RESTRAINT = ("insufficient", "reformulate")
#: How a refusal begins, how an answer limits itself, and what in an answer is code, a call, a link or a placeholder.
REFUSAL = (
    r"(?i)^\s*(?:#+[^\n]*\n\s*)?(?:(?:当前|目前|现有|本轮|就目前)\s*)?(?:"
    r"(?:候选|相关|现有)[^\n]{0,18}(?:未发现|没有发现|没有支持|未覆盖)|"
    r"(?:资料|信息|证据|检索结果)(?:[^\n]{0,18})?(?:不足|不够|缺失|为空|没有|未覆盖)|"
    r"(?:候选|相关|现有|资料|信息|证据|检索结果)[^\n]{0,18}不支持(?:回答|作答|确认|判断|确定|给出结论|该问题)|"
    r"(?:无法|不能|不可|不应)(?:[^\n]{0,18})?(?:确认|回答|作答|判断|确定|提供)|"
    r"(?:没有找到|未找到|找不到)(?:[^\n]{0,18})(?:资料|证据|来源)|"
    r"需要(?:更多|补充)(?:[^\n]{0,18})(?:资料|信息|来源|证据))"
)
LIMITATION = (
    r"(?i)(?:资料|信息|证据|检索结果)(?:[^\n]{0,24})?(?:不足|不够|缺失|未覆盖|有限)|"
    r"(?:本轮|当前|目前)(?:[^\n]{0,24})(?:未覆盖|无法确认|不能确认|不作判断)|"
    r"(?:只|仅)(?:能|做|可|会)?[^\n]{0,18}(?:复述|转述|说明|回答|概括|总结|列出)"
)
FENCED = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?^[ \t]*\1[ \t]*$"
CALL = r"(?i)\b(?:rag_[a-z_]+|vault_[a-z_]+|memory_[a-z_]+|bili_[a-z_]+|article_[a-z_]+|context_[a-z_]+)\s*\([^()\n]*\)"
INLINE = r"`+[^`\n]*`+"
LINK = r"\[\[([^\]|\n]+?)(?:\|[^\]\n]*)?\]\]"
PLACEHOLDERS = ("wikilink", "link", "source", "ref", "reference", "来源", "引用")
PLACEHOLDER = r"\{[^{}]+\}|\.\.\.|…"


def label_of(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("answerable"))))


def evidence_gate(tasks: DataFrame, items: DataFrame, allow_candidate: bool = False) -> DataFrame:
    """(task_id, status, allowed, reasons) for every row of ``tasks`` (task_id, answerability, project_id, required, forbidden).

    ``items``: task_id, place, ref, status, project_id, the rows retrieved for a task, some tens at most. A row counts unless it is
    inactive, of another project, forbidden, or without reference where a boundary is set; all of ``required`` have to be there."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rules = tasks.select("task_id", label_of(F.col("answerability")).alias("label"), text("project_id").alias("scope"), *[F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda r: F.trim(r) != "").alias(c) for c in ("required", "forbidden")])
    rows = items.select("task_id", "place", text("ref").alias("ref"), F.lower(F.trim(F.coalesce("status", F.lit("active")))).alias("status"), text("project_id").alias("project"))
    bound = (F.size("required") > 0) | (F.size("forbidden") > 0) | (F.col("scope") != "")
    inactive = F.lit(False) if allow_candidate else F.col("status").isin(*INACTIVE)
    reason = (
        F.when((F.col("ref") == "") & bound, "missing_ref").when(F.col("ref") == "", "")
        .when(inactive, F.concat(F.lit("inactive:"), "status"))
        .when((F.col("scope") != "") & ~F.col("project").isin("", "default") & (F.col("project") != F.col("scope")), "scope_denied")
        .when(F.exists("forbidden", lambda f: same_reference(f, F.col("ref"))), "forbidden_ref").otherwise("")
    )
    judged = rows.join(rules.select("task_id", "scope", "required", "forbidden"), "task_id").select("task_id", F.struct("place", "ref", reason.alias("reason")).alias("row"))
    gathered = judged.groupBy("task_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    every = rules.join(gathered, "task_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<place: int, ref: string, reason: string>>")))
    good = F.filter("rows", lambda r: r["reason"] == "")
    allowed = F.transform(F.filter(good, lambda r: r["ref"] != ""), lambda r: r["ref"])
    told = F.array_distinct(F.transform(F.filter("rows", lambda r: r["reason"] != ""), lambda r: r["reason"]))
    lacking = ~F.forall("required", lambda e: F.exists(good, lambda r: same_reference(e, r["ref"])))
    none = F.array().cast("array<string>")
    said = lambda status, own, why: F.struct(F.lit(status).alias("status"), own.alias("allowed"), why.alias("reasons"))
    one = lambda why: F.array(F.lit(why))
    verdict = (
        F.when(F.col("label").isin(*ABSENT), said("insufficient", none, one("answerability_absent")))
        .when(F.col("label") == "insufficient", said("insufficient", none, one("answerability_insufficient")))
        .when(F.col("label") == "conflicting", said("conflicting", none, one("conflicting_evidence")))
        .when(F.size(good) == 0, said("insufficient", none, F.when(F.size(told) > 0, told).otherwise(one("no_usable_evidence"))))
        .when(lacking, said("insufficient", allowed, F.array_distinct(F.concat(told, one("required_ref_missing")))))
        .otherwise(said("answerable", allowed, told))
    )
    return every.select("task_id", verdict.alias("v")).select("task_id", "v.*")


def cited_tokens(answer: Column, refs: Column) -> Column:
    """What an answer cites: its links outside fenced code, and the files of ``refs`` that it names in prose."""
    visible = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), FENCED, " "), CALL, " ")
    links = F.transform(F.regexp_extract_all(visible, F.lit(LINK), 1), F.trim)
    real = F.filter(links, lambda t: (t != "") & ~F.lower(t).isin(*PLACEHOLDERS) & ~t.rlike(PLACEHOLDER))
    prose = F.regexp_replace(F.regexp_replace(visible, INLINE, " "), LINK, " ")
    files = F.filter(F.transform(refs, lambda r: F.substring_index(r, "#", 1)), lambda f: F.contains(F.lower(f), F.lit(".md")) & F.contains(prose, f))
    return F.array_distinct(F.concat(real, files))


def answer_gate(answers: DataFrame, require_citation: bool = True, allow_partial: bool = False) -> DataFrame:
    """(task_id, status, cited, reason, abstained) of ``answers`` (task_id, answer, refs, answerability, assessment): labels first, then
    the assessment, evidence, citations outside of ``refs``, refusals, missing citations."""
    none = F.array().cast("array<string>")
    refs = F.array_distinct(F.filter(F.transform(F.coalesce("refs", none), F.trim), lambda r: r != ""))
    rows = answers.select("task_id", F.coalesce("answer", F.lit("")).alias("answer"), refs.alias("refs"), label_of(F.col("answerability")).alias("label"), F.lower(F.trim(F.coalesce("assessment", F.lit("")))).alias("assessed"))
    rows = rows.withColumn("tokens", cited_tokens(F.col("answer"), F.col("refs"))).withColumn("abstained", (F.trim("answer") != "") & F.trim("answer").rlike(REFUSAL))
    meets = lambda a, b: same_reference(a, b) | same_reference(b, a)
    cited = F.filter("refs", lambda r: F.exists("tokens", lambda t: meets(r, t)))
    outside = F.exists("tokens", lambda t: ~F.exists("refs", lambda r: meets(t, r)))
    restrained = F.col("assessed").isin(*RESTRAINT)
    said = lambda status, own, reason: F.struct(F.lit(status).alias("status"), own.alias("cited"), reason.alias("reason"))
    insufficient = lambda reason, own=none: said("insufficient", own, reason)
    why = F.when(F.col("label") == "scope_denied", "scope_denied").when(F.col("label") == "insufficient", "answerability_insufficient").otherwise("answerability_absent")
    partial = restrained & F.lit(allow_partial) & (F.col("label") == "answerable") & (F.size(cited) > 0) & F.col("answer").rlike(LIMITATION)
    verdict = (
        F.when(F.col("label").isin(*ABSENT, "insufficient", "scope_denied"), insufficient(why))
        .when(F.col("label") == "conflicting", said("conflicting", none, F.lit("conflicting_evidence")))
        .when(restrained & ~F.col("abstained") & F.lit(not allow_partial), insufficient(F.lit("assessment_requires_abstention")))
        .when(F.size("refs") == 0, insufficient(F.lit("no_usable_evidence")))
        .when(outside, insufficient(F.lit("citation_out_of_scope"), cited))
        .when(F.col("abstained"), insufficient(F.lit("explicit_abstention"), cited))
        .when(F.lit(require_citation) & (F.size(cited) == 0), insufficient(F.lit("citation_missing")))
        .when(partial, said("answerable", cited, F.lit("bounded_partial")))
        .when(restrained, insufficient(F.lit("assessment_requires_abstention"), cited))
        .otherwise(said("answerable", cited, F.lit("")))
    )
    return rows.select("task_id", "abstained", verdict.alias("v")).select("task_id", "v.*", "abstained")
