"""Message routing with quarantine, batches after a cursor, collection windows, budgets."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from .graph import cut
from .names import name_places


def searched_lines(text: Column) -> Column:
    """Lines of a message that names are looked for in: structs (in_field, line) of its company fields and of the lines that name
    no counter-party."""
    fields = F.transform(codes.company_fields(text), lambda v: F.struct(F.lit(True).alias("in_field"), v.alias("line")))
    return F.concat(fields, F.transform(codes.fallback_lines(text), lambda v: F.struct(F.lit(False).alias("in_field"), v.alias("line"))))


def routed(messages: DataFrame, companies: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, stock_code, status, reason, parsed_code, term): one row an assignment or quarantine; silent drops have status 'dropped'.

    companies: stock_code, terms (array of names and aliases), requires_code.  Explicit codes join by equality; ``parsed_code`` is
    the code a message states.  Messages without a code are searched for terms in their company fields, and where no term stands
    there in their other lines; ``term`` is the term that quarantines one (the first of a company's, in order).  Codes and lines
    are taken from the texts once.
    """
    stated = codes.codes_by_level(F.col(text_col))
    found = cut(messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), stated["codes"].alias("codes")).select("id", "codes", F.when(F.size("codes") == 0, searched_lines(F.col("text"))).alias("lines")))
    terms = companies.select("stock_code", "requires_code", F.explode("terms").alias("term")).distinct()
    # spread by message once: both groupings need no other shuffle, and a term that stands in several places counts once in them
    hits = name_places(found.where("lines is not null").select("id", F.inline("lines")), terms).repartition("id")
    met = hits.groupBy("id", "in_field", "stock_code").agg(F.bool_or("requires_code").alias("requires_code"), F.min("term").alias("term"))
    one = F.struct("stock_code", "requires_code", "term")
    per_message = met.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("in_field"), one))).alias("by_field"), F.array_sort(F.collect_set(F.when(~F.col("in_field"), one))).alias("by_line"))
    known = companies.select(F.col("stock_code").alias("code"), F.lit(True).alias("known")).distinct()
    code = F.get("codes", F.lit(0))
    joined = found.select("id", "codes", F.when(F.size("codes") == 1, code).alias("code")).join(known, "code", "left").join(per_message, "id", "left")
    matched = F.when(F.size("by_field") > 0, F.col("by_field")).otherwise(F.col("by_line"))

    def outcome(stock_code: Column | None, status: str, reason: str | None = None, parsed: Column | None = None, term: Column | None = None) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c
        return F.struct(text(stock_code).alias("stock_code"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), text(parsed).alias("parsed_code"), text(term).alias("term"))

    rows = joined.withColumn("matched", F.coalesce(matched, F.array().cast("array<struct<stock_code:string,requires_code:boolean,term:string>>")))
    blocked = F.transform(F.filter("matched", lambda m: m["requires_code"]), lambda m: outcome(m["stock_code"], "quarantine", "target_requires_explicit_code", None, m["term"]))
    permitted = F.filter("matched", lambda m: ~m["requires_code"])
    by_name = F.concat(blocked, F.when(F.size(permitted) == 1, F.array(outcome(F.get(permitted, F.lit(0))["stock_code"], "assigned"))).when(F.size(permitted) > 1, F.array(outcome(None, "quarantine", "ambiguous_alias_match", None, F.get(permitted, F.lit(0))["term"]))).otherwise(F.array().cast("array<struct<stock_code:string,status:string,reason:string,parsed_code:string,term:string>>")))
    outcomes = (
        F.when(F.size("codes") > 1, F.array(outcome(None, "quarantine", "ambiguous_explicit_codes")))
        .when(F.col("known"), F.array(outcome(F.col("code"), "assigned", None, F.col("code"))))
        .when(F.col("code").isNotNull(), F.array(outcome(F.col("code"), "quarantine", "code_not_in_portfolio", F.col("code"))))
        .when(F.size("matched") > 0, by_name).otherwise(F.array(outcome(None, "dropped")))
    )
    return rows.select("id", F.inline(outcomes))


def batch_after(messages: DataFrame, cursor: Column | int, size: int, id_col: str = "id") -> DataFrame:
    """The next ``size`` distinct messages after the cursor, in id order (a top-k, not a sort)."""
    return messages.where(F.col(id_col) > cursor).dropDuplicates([id_col]).orderBy(id_col).limit(size)


def collection_start(now: Column, last: Column, *, overlap_hours: int = 3, most_hours: int = 16, backfill_days: int = 7, backfill: Column | bool = False) -> Column:
    """Start of the window to collect: a week without a success, else the last success less the overlap, within the look-back."""
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    whole = now - F.make_dt_interval(F.lit(backfill_days))
    return F.when(F.lit(backfill) | last.isNull(), whole).otherwise(F.greatest(now - hours(most_hours), last - hours(overlap_hours)))


def budget_gate(requests: DataFrame, provider: str, order: str, budget: str, actual: str, limit: int, daily: str | None = None, daily_limit: int = 1_000_000_000) -> DataFrame:
    """Sequential gate: a request runs if the calls made so far plus its budget stay in the limit of the run, and with
    ``daily`` (a day column) in that of the day; adds ``allowed``.

    What counts is what earlier requests really used, so each decision hangs on all before it.  It is a scan all the same that
    splits: rows are dealt to ranges of (provider, order), and a stretch of one provider and day does nothing but turn what is
    free at its start into what it uses.  That function is written down for every start at once (``uses_by_start``), the
    functions of a provider's stretches are applied one after the other, and every stretch then decides its rows from its own
    start.  A provider with most rows is as many tasks as it has ranges.
    """
    day = F.col(daily).cast("string") if daily else F.lit("")
    columns = requests.columns
    keyed = requests.select("*", day.alias("gate_day")).repartitionByRange(provider, order).sortWithinPartitions(provider, order)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    at = {c: keyed.columns.index(c) for c in (provider, "gate_day", budget, actual)}

    def numbered(batches):
        """Adds the number of the stretch within the partition."""
        last, n = None, -1
        for batch in batches:
            numbers = []
            for key in zip(batch.column(at[provider]).to_pylist(), batch.column(at["gate_day"]).to_pylist(), strict=True):
                if n < 0 or key != last:
                    last, n = key, n + 1
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], [*batch.schema.names, "gate_stretch"])

    rows = cut(keyed.mapInArrow(numbered, f"{out_schema}, gate_stretch int").withColumn("gate_range", F.spark_partition_id()))
    kind = rows.schema[provider].dataType.simpleString()
    free = min(limit, daily_limit)

    def summed(batches):
        """One row a stretch: what it uses from each start."""
        held, who_type = None, None
        for batch in batches:
            who_type = batch.schema.field(at[provider]).type
            for who, when, want, real, stretch, part in zip(*(batch.column(k).to_pylist() for k in (at[provider], at["gate_day"], at[budget], at[actual], -2, -1)), strict=True):
                if held is not None and held[0][2:] != (part, stretch):
                    yield _stretch(held, provider, who_type)
                    held = None
                if held is None:
                    held = ((who, when, part, stretch), [0], [0])
                uses_by_start(held[1], held[2], want, real, free)
        if held is not None:
            yield _stretch(held, provider, who_type)

    stretches = rows.mapInArrow(summed, f"`{provider}` {kind}, gate_day string, gate_range int, gate_stretch int, lows array<long>, uses array<long>")

    def chained(pdf):
        """Start of each stretch of a provider: what is free in the run and the day."""
        used, day_now, today, starts = 0, None, 0, []
        for when, lows, uses in zip(pdf["gate_day"], pdf["lows"], pdf["uses"], strict=True):
            if when != day_now:
                day_now, today = when, 0
            start = min(limit - used, daily_limit - today)
            starts.append(start)
            used_here = int(uses[bisect_right(lows, start) - 1]) if start >= 0 else 0
            used, today = used + used_here, today + used_here
        return pdf[["gate_range", "gate_stretch"]].assign(start=starts)

    ordered = lambda pdf: chained(pdf.sort_values(["gate_range", "gate_stretch"]))
    starts = stretches.groupBy(provider).applyInPandas(ordered, "gate_range int, gate_stretch int, start long")

    def decided(batches):
        last, free_now = None, 0
        for batch in batches:
            allowed = []
            for want, real, stretch, part, start in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (budget, actual, "gate_stretch", "gate_range", "start")), strict=True):
                if (part, stretch) != last:
                    last, free_now = (part, stretch), start
                allowed.append(want <= free_now)
                free_now -= real if allowed[-1] else 0
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(allowed, pa.bool_())], [*columns, "allowed"])

    met = rows.join(starts, ["gate_range", "gate_stretch"]).repartition("gate_range", "gate_stretch").sortWithinPartitions("gate_range", "gate_stretch", order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", allowed boolean"
    return met.mapInArrow(decided, schema)


def uses_by_start(lows: list[int], uses: list[int], want: int, real: int, free: int) -> None:
    """One more request at the end of a stretch: with lows[k] up to below lows[k + 1] free at the start, uses[k] are used.

    Starts with room for the request use ``real`` more, so an interval may fall in two; equal neighbours become one.
    """
    if not real:
        return
    new_lows: list[int] = []
    new_uses: list[int] = []

    def add(low: int, use: int) -> None:
        if not new_uses or new_uses[-1] != use:
            new_lows.append(low)
            new_uses.append(use)

    for k, (low, use) in enumerate(zip(lows, uses, strict=True)):
        end = lows[k + 1] if k + 1 < len(lows) else free + 1
        room = want + use  # least start that lets the request through
        if room > low:
            add(low, use)
        if room < end:
            add(max(low, room), use + real)
    lows[:], uses[:] = new_lows, new_uses


def _stretch(held: tuple, provider: str, who_type: pa.DataType) -> pa.RecordBatch:
    key, lows, uses = held
    kinds = (who_type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((*key, lows, uses), kinds, strict=True)], [provider, "gate_day", "gate_range", "gate_stretch", "lows", "uses"])


def budget_bound(requests: DataFrame, provider: str, order: list[Column], budget: str, limit: int) -> DataFrame:
    """Prefix-sum form of the gate: what surely fits if every request uses its whole budget."""
    total = F.sum(budget).over(Window.partitionBy(provider).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.withColumn("running", total).withColumn("allowed", F.col("running") <= limit)


def cursor_updated(cursors: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Cursors after a run: success moves times and clears the error, failure keeps times and counts up."""
    both = cursors.join(outcomes, key, "full")
    ok = F.coalesce(F.col("ok"), F.lit(None))
    return both.select(
        *key,
        F.when(ok, F.col("run_at")).otherwise(F.col("last_successful_run")).alias("last_successful_run"),
        F.when(ok, F.coalesce(F.greatest("newest_article", "last_article_published_at"), "last_article_published_at")).otherwise(F.col("last_article_published_at")).alias("last_article_published_at"),
        F.when(ok, F.lit(None)).when(~ok, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(ok, F.lit(0)).when(~ok, F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(F.coalesce("consecutive_failures", F.lit(0))).cast("int").alias("consecutive_failures"),
    )
