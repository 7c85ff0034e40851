"""Article enrichment for whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions import text
from pressgrid.functions.dates import month_start
from pressgrid.functions.urls import cleaned_url, known_domain
from pressgrid.operators.audit import log_context, log_row, write_log
from pressgrid.operators.dictionary import any_found, entries, joined_values, match_names
from pressgrid.operators.joins import domain_lookup, domain_lookup_exact
from pressgrid.operators.ordering import fill_missing_ids
from pressgrid.operators.quality import completeness_report, mark_complete
from pressgrid.operators.transforms import fill_defaults, fill_language, flag_brand_headline, needs_fill, update_content
from pressgrid.schemas import conform

ROW_KEY = ["url", "updated_at", "id"]


@dataclass
class Dictionaries:
    """The name lists and the domain dimension articles are compared with."""

    people: DataFrame
    investors: DataFrame
    reporters: DataFrame
    companies: DataFrame
    media: DataFrame

    def names(self) -> DataFrame:
        """All names as one list, so that a text is cut into tokens once."""
        return (
            entries(self.companies, "portco_name", "company", location="portco_location", lead="portco_deal_lead",
                    ai="ai", vehicle="vehicle")
            .unionByName(entries(self.investors, "investor", "investor", rank="rank"), allowMissingColumns=True)
            .unionByName(entries(self.people, "spokesperson_name", "person"), allowMissingColumns=True)
            .unionByName(entries(self.reporters, "tagged_reporter", "reporter"), allowMissingColumns=True)
        )


STOPPING = ["SELECT", "ASSIGN_ID", "GUARD_CONTENT"]
DEEP_STEPS = ["ENRICH_SPOKES", "ENRICH_INVESTORS", "ENRICH_REPORTERS", "ENRICH_PORTCOS", "KEYWORDS", "MEDIA_META"]


def _unreadable(*names: str) -> Column:
    return F.coalesce(*(F.when(~F.is_valid_utf8(F.col(n)), F.lit(f"{n} is no valid UTF-8")) for n in names))


def step_failures(extra: dict[str, Column] | None = None) -> Column:
    """The steps a row fails in, as (step, message), in their order.

    A row without URL or id ends at once, and one that fails in the guard ends there; any other failed step is passed over.
    Texts that are no valid UTF-8 fail in the steps that read them. `extra` adds conditions: step -> message, or null where
    the step can be done; built from try forms (try_cast, try_parse_url), it is how a step that would throw is kept to its row.
    """
    extra = extra or {}
    known = {
        "SELECT": F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "no url"),
        "ASSIGN_ID": F.when(F.col("id").isNull(), "no id"),
        "NORMALIZE": _unreadable("url", "title", "content"),
        "ENRICH_SPOKES": _unreadable("title", "content"),
        **{s: _unreadable("content") for s in DEEP_STEPS[1:5]},
        "MEDIA_META": _unreadable("domain"),
    }
    unknown = set(extra) - {*known, "GUARD_CONTENT"}
    if unknown:
        raise ValueError(f"no such steps: {', '.join(sorted(unknown))}")

    def failure(step: str) -> Column:
        message = F.coalesce(*(m for m in (known.get(step), extra.get(step)) if m is not None), F.lit(None).cast("string"))
        return F.when(message.isNotNull(), F.struct(F.lit(step).alias("step"), message.alias("message")))

    def listed(*steps: str) -> Column:
        return F.array_compact(F.array(*(failure(s) for s in steps)))

    first = F.coalesce(failure("SELECT"), failure("ASSIGN_ID"))
    deep = text.passes_guard(F.col("content")) & failure("GUARD_CONTENT").isNull()
    return F.when(first.isNotNull(), F.array(first)).otherwise(
        F.concat(listed("NORMALIZE", "GUARD_CONTENT"), F.when(deep, listed(*DEEP_STEPS)).otherwise(F.array().cast("array<struct<step:string,message:string>>"))))


def failed(step: str) -> Column:
    return F.exists("step_errors", lambda e: e["step"] == step)


def normalize_fields(rows: DataFrame, brand: str, as_of: Column, apply: Column, recompute: bool = True) -> DataFrame:
    """Cleaned URL, domain, date, month, language and brand flags."""
    values = {
        "cleaned_url": F.coalesce("cleaned_url", cleaned_url(F.col("url"))),
        "domain": F.coalesce("domain", known_domain(F.col("domain"), F.col("url"))),
        "publish_date": F.coalesce("publish_date", as_of.cast("date")),
        "month": month_start(F.col("publish_date"), as_of),
        "language": text.detect_language(F.col("content"), F.col("language")),
        "brand_in_headline": text.has_word(F.col("title"), [brand]),
        "tagged_brand": text.tag_brand(
            F.col("title"), F.col("content"), F.col("managed_by_fund"), brand,
            current=None if recompute else F.col("tagged_brand")),
        "updated_at": as_of,
    }
    return rows.withColumns({c: F.when(apply, v).otherwise(F.col(c)) for c, v in values.items()})


def match_fields(
    rows: DataFrame, names: DataFrame, apply: Column, how: str = "auto", allowed: dict[str, Column] | None = None,
) -> DataFrame:
    """People, investors, reporters and companies named in the text; a text without any keeps its earlier values.

    `allowed`: kind of name -> rows in which its step is done.
    """
    may = allowed or {}
    texts = {"_body": F.when(apply, F.col("content")), "_head": F.when(apply, F.col("title"))}
    found = match_names(rows, names, texts, how)

    def keep(kind: str, field: str, old: str) -> Column:
        done = any_found("_body", kind) & may[kind] if kind in may else any_found("_body", kind)
        return F.when(done, joined_values("_body", field, kind)).otherwise(F.col(old))

    matched = found.withColumns({
        "matched_spokespeople": keep("person", "name", "matched_spokespeople"),
        "spokespeople_in_headline": F.when(apply & may.get("person", F.lit(True)), any_found("_head", "person")).otherwise(F.col("spokespeople_in_headline")),
        "matched_vc_investors": keep("investor", "name", "matched_vc_investors"),
        "matched_dealroom_rank": keep("investor", "rank", "matched_dealroom_rank"),
        "matched_reporter": keep("reporter", "name", "matched_reporter"),
        "matched_portcos": keep("company", "name", "matched_portcos"),
        "matched_portco_location": keep("company", "location", "matched_portco_location"),
        "matched_portco_deal_lead": keep("company", "lead", "matched_portco_deal_lead"),
        "matched_portco_ai": keep("company", "ai", "matched_portco_ai"),
        "matched_vehicle": keep("company", "vehicle", "matched_vehicle"),
    })
    tagged = F.coalesce(F.col("matched_portcos") != "", F.lit(False))
    win = text.unbranded_win(F.col("matched_portcos"), F.col("brand_in_headline"))
    apply = apply & may.get("company", F.lit(True))
    return matched.withColumns({
        "tagged_portco": F.when(apply, tagged).otherwise(F.col("tagged_portco")),
        "unbranded_win": F.when(apply, win).otherwise(F.col("unbranded_win"))}).drop("_body", "_head")


def keyword_fields(rows: DataFrame, apply: Column, kill_pill: list[str], unwanted: list[str], boundary: str) -> DataFrame:
    content, low = F.col("content"), F.col("_low")
    flags = {
        **text.keyword_flags(content, "kill_pill", kill_pill, boundary, low),
        **text.keyword_flags(content, "unwanted", unwanted, boundary, low),
    }
    lowered = rows.withColumn("_low", F.when(apply, F.lower(F.coalesce(content, F.lit("")))))
    return lowered.withColumns({c: F.when(apply, v).otherwise(F.col(c)) for c, v in flags.items()}).drop("_low")


def enrich_with_errors(
    articles: DataFrame, dictionaries: Dictionaries, brand: str, as_of: Column, *,
    kill_pill: list[str] | None = None, unwanted: list[str] | None = None, boundary: str = "ascii",
    recompute: bool = True, assign_missing_ids: bool = True, how: str = "auto", fails: dict[str, Column] | None = None,
) -> DataFrame:
    """All enrichment steps for every row of the table, with `step_errors`: the (step, message) pairs of each row.

    Rows without a URL pass unchanged. Rows whose content is too short stop
    after normalisation. A step that fails for a row (`step_failures`, more by `fails`) leaves the row's columns as they were, and the row goes
    on. Bodies stay in place: dictionary matching, keyword
    flags and (for a small dimension) the domain look-up run in the scan.
    """
    table = conform(articles)
    if assign_missing_ids:
        table = fill_missing_ids(table)
    rows = table.withColumn("step_errors", step_failures(fails))
    # decided once per row and carried as columns, not tested again in every step
    named = ~(failed("SELECT") | failed("ASSIGN_ID"))
    rows = rows.withColumns({"_due": named, "_deep": named & text.passes_guard(F.col("content")) & ~failed("GUARD_CONTENT")})
    due, deep = F.col("_due"), F.col("_deep")
    kinds = {"person": "ENRICH_SPOKES", "investor": "ENRICH_INVESTORS", "reporter": "ENRICH_REPORTERS", "company": "ENRICH_PORTCOS"}
    rows = normalize_fields(rows, brand, as_of, due & ~failed("NORMALIZE"), recompute)
    rows = match_fields(rows, dictionaries.names(), deep, how, {k: ~failed(step) for k, step in kinds.items()})
    rows = keyword_fields(rows, deep & ~failed("KEYWORDS"), kill_pill or text.KILL_PILL, unwanted or text.UNWANTED, boundary)
    return domain_lookup(rows, dictionaries.media, ROW_KEY, apply=deep & ~failed("MEDIA_META")).drop("_due", "_deep")


def enrich_articles(articles: DataFrame, dictionaries: Dictionaries, brand: str, as_of: Column, **options) -> DataFrame:
    """The table that `enrich_with_errors` makes, without the errors."""
    return enrich_with_errors(articles, dictionaries, brand, as_of, **options).drop("step_errors")


def enrichment_log(enriched: DataFrame, run_id: Column, started: Column, ts: Column) -> DataFrame:
    """The audit rows of one enrichment run, per article.

    With the column `step_errors`, a failed step has an ERROR row with its message, and a row
    that ends at a step has no later ones; without it every step counts as done.
    """
    evaluated = "step_errors" in enriched.columns
    nothing = F.lit("{}")
    going = F.lit(True)

    def wrong(step: str) -> Column:
        return failed(step) if evaluated else F.lit(False)

    def row(step: str, severity: str, message, context: Column) -> Column:
        return log_row(step, severity, message, context, run_id, F.col("url"), "enrich_articles", started, ts)

    def done(step: str, message: str, context: Column, when: Column) -> Column:
        good = row(step, "INFO", message, context)
        if not evaluated:
            return F.when(when, good)
        said = F.element_at(F.filter("step_errors", lambda e: e["step"] == step), 1)["message"]
        return F.when(when & wrong(step), row(step, "ERROR", said, nothing)).when(when, good)

    steps = [row("START", "INFO", "begin", nothing), F.when(wrong("SELECT"), done("SELECT", "", nothing, F.lit(True)))]
    going = ~wrong("SELECT")
    steps.append(done("ASSIGN_ID", "resolved id", log_context("id"), going))
    going = going & ~wrong("ASSIGN_ID")
    steps.append(done("NORMALIZE", "normalized", log_context("cleaned_url", "domain", "language"), going))
    steps.append(done("GUARD_CONTENT", "content length", log_context(
        F.length(F.trim(F.coalesce("content", F.lit("")))).alias("len")), going))
    going = going & ~wrong("GUARD_CONTENT")
    deep = text.passes_guard(F.col("content"))
    steps.append(F.when(going & ~deep, row("SKIP", "WARN", f"content too short (<{text.GUARD_LENGTH})", log_context("id"))))
    contexts = {
        "ENRICH_SPOKES": log_context("matched_spokespeople"), "ENRICH_INVESTORS": log_context("matched_vc_investors", "matched_dealroom_rank"),
        "ENRICH_REPORTERS": log_context("matched_reporter"), "ENRICH_PORTCOS": log_context("matched_portcos"),
        "KEYWORDS": nothing, "MEDIA_META": log_context("country")}
    steps += [done(step, "done", contexts[step], going & deep) for step in DEEP_STEPS]
    steps.append(F.when(going & deep, row("DONE", "INFO", "completed", log_context("id"))))
    return write_log(enriched, steps)


def enrich_backlog(articles: DataFrame, media: DataFrame, brand: str, as_of: Column, all_rows: bool = True) -> DataFrame:
    """Defaults, country and tier by exact domain, language, brand in headline."""
    rows = fill_defaults(conform(articles), as_of, None if all_rows else needs_fill())
    rows = domain_lookup_exact(rows, media, ROW_KEY)
    return flag_brand_headline(fill_language(rows), brand)


def fill_all_cells(
    articles: DataFrame, bodies: DataFrame, media: DataFrame, brand: str, as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """(table with bodies stored, enriched and marked; completeness report before and after).

    `bodies`: id, content, title, publish_date; only rows lacking content take them.
    """
    table = conform(articles)
    lacking = F.col("content").isNull() | (F.col("content") == "")
    waiting = table.filter(lacking & F.col("url").isNotNull()).select("id").distinct()
    usable = bodies.filter(F.length("content") > 50).join(waiting, "id", "left_semi")
    done = mark_complete(enrich_backlog(update_content(table, usable, as_of), media, brand, as_of))
    report = completeness_report(table).withColumn("stage", F.lit("before")).unionByName(
        completeness_report(done).withColumn("stage", F.lit("after")))
    return done, report
