"""Asset lifecycle: warranties, maintenance due, deferred work, capital plans, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warranty_status(today: Column, starts: Column, ends: Column, voided: Column, within_days: int = 90) -> Column:
    """Cover is inclusive on both dates; expiring means active and ending within the window."""
    return (
        F.when(voided.isNotNull() & (voided <= today), "voided")
        .when(today < starts, "pending")
        .when(today > ends, "expired")
        .when(F.datediff(ends, today) <= within_days, "expiring")
        .otherwise("active")
    )


def pm_due(tasks: DataFrame, today: Column) -> DataFrame:
    """Due date and status of calendar tasks (id, last_done, every_days), most urgent first."""
    due = F.date_add("last_done", F.col("every_days"))
    left = F.datediff(due, today)
    rank = F.when(left < 0, 0).when(left <= 14, 1).otherwise(2)
    status = F.when(left < 0, "overdue").when(left <= 14, "due").otherwise("later")
    return tasks.select("id", due.alias("due_at"), status.alias("status"), rank.alias("rank")).orderBy("rank", "due_at", "id")


def condition_index(deferred: DataFrame, values: DataFrame, installed: DataFrame) -> DataFrame:
    """FCI: open deferred cost over the newest replacement values of installed assets; null without value."""
    newest = values.groupBy("asset_id").agg(F.max_by("value", "as_of").alias("value")).join(installed.select("asset_id").distinct(), "asset_id", "left_semi")
    cost = deferred.where("status = 'open'").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    total = newest.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    return cost.crossJoin(F.broadcast(total)).select("cost", "value", F.try_divide("cost", F.nullif("value", F.lit(0.0))).alias("fci"))  # one row each


def capital_plan(assets: DataFrame, deferred: DataFrame, year: int) -> DataFrame:
    """Cost per year: replacements at end of life, never before this year, and open deferred work at its target year.

    Assets are (first_year, median_years, value); deferred rows (target_year, cost, status).
    """
    eol = F.greatest(F.col("first_year") + F.bround("median_years").cast("int"), F.lit(year))
    a = assets.select(eol.alias("year"), F.col("value").alias("replace"), F.lit(0.0).alias("repair"))
    d = deferred.where("status = 'open'").select(F.greatest("target_year", F.lit(year)).alias("year"), F.lit(0.0).alias("replace"), F.col("cost").alias("repair"))
    return a.unionByName(d).groupBy("year").agg(F.sum("replace").alias("replace"), F.sum("repair").alias("repair"))


def schedule_value(at: DataFrame, weekly: DataFrame, exceptions: DataFrame, default: float) -> DataFrame:
    """Value of a weekly schedule (dow, minute, value) with dated exceptions (day, priority, minute, value) at each `ts`.

    The exception of the best priority with an entry by then wins, else the weekday's latest entry,
    else the default. Monday is 0.
    """
    rows = at.select("id", "ts", F.weekday("ts").alias("dow"), F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("now"))
    ex = rows.join(exceptions.withColumnRenamed("value", "ev"), "day").where("minute <= now")
    ex = ex.groupBy("id").agg(F.min_by("ev", F.struct("priority", -F.col("minute"))).alias("ev"))
    wk = rows.join(weekly.withColumnRenamed("value", "wv"), "dow").where("minute <= now").groupBy("id").agg(F.max_by("wv", "minute").alias("wv"))
    return rows.join(ex, "id", "left").join(wk, "id", "left").select("id", "ts", F.coalesce("ev", "wv", F.lit(default)).alias("value"))


def schedule_transitions(days: DataFrame, weekly: DataFrame, exceptions: DataFrame, default: float, zone: str | None = None) -> DataFrame:
    """(ts, value) of every change of the scheduled value over the days (day), the first instant aside.

    Only midnights and the times of entries can change the value; each is valued once, and those that
    change nothing drop out. `zone` turns local instants into UTC.
    """
    from pyspark.sql.window import Window

    at = lambda rows: rows.select((F.unix_micros(F.col("day").cast("timestamp")) + F.col("minute").cast("long") * 60_000_000).alias("t"))
    dated = days.select("day", F.weekday("day").alias("dow"))
    times = at(dated.withColumn("minute", F.lit(0))).unionByName(at(dated.join(weekly, "dow"))).unionByName(at(dated.join(exceptions, "day"))).distinct()
    local = times.select(F.col("t").alias("id"), F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))
    valued = schedule_value(local, weekly, exceptions, default)
    # A site's schedule has a few changes a day: one row each, so one ordered window holds few rows.
    was = F.lag("value").over(Window.orderBy("ts"))
    changed = valued.withColumn("was", was).where("was is not null and was <> value")
    ts = F.col("ts") if zone is None else F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone).cast("timestamp_ntz")
    return changed.select(ts.alias("ts"), "value")


def week_n_day(day: Column, month: int | None = None, week: int | None = None, weekday: int | None = None) -> Column:
    """Calendar pattern by month (13 odd, 14 even), week of the month (6: its last seven days) and weekday (Monday 0)."""
    keep = F.lit(True)
    if month is not None:
        keep = F.month(day) % 2 == (1 if month == 13 else 0) if month in (13, 14) else F.month(day) == month
    if weekday is not None:
        keep = keep & (F.weekday(day) == weekday)
    if week == 6:
        keep = keep & (F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 7)
    elif week is not None:
        keep = keep & (F.dayofmonth(day) > (week - 1) * 7) & (F.dayofmonth(day) <= week * 7)
    return keep


def in_date_range(day: Column, lo: str | None, hi: str | None) -> Column:
    """Inclusive range of ISO dates; an end that is None is open."""
    keep = F.lit(True) if lo is None else day >= F.lit(lo).cast("date")
    return keep if hi is None else keep & (day <= F.lit(hi).cast("date"))


def cost_by_risk(deferred: DataFrame) -> DataFrame:
    """(risk, items, cost) of open deferred work."""
    return deferred.where("status = 'open'").groupBy("risk").agg(F.count("*").alias("items"), F.sum("cost").alias("cost"))


def cell_totals(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Region recall and cell precision, recall and F1 of extracted tables (title, row, head, value).

    Blank cells don't count. A cell is right where the same title, row and head have the same value;
    a region counts as found when any of its cells was predicted.
    """
    clean = lambda d: d.where("trim(coalesce(value, '')) <> ''").select(*(F.lower(F.trim(c)).alias(c) for c in ("title", "row", "head", "value")))
    t, p = clean(truth), clean(predicted)
    right = p.join(t, ["title", "row", "head", "value"], "left_semi").agg(F.count("*").alias("tp"))
    regions = truth.select(F.lower(F.trim("title")).alias("title")).distinct()
    found = regions.join(predicted.select(F.lower(F.trim("title")).alias("title"), F.lit(1).alias("hit")).distinct(), "title", "left")
    counts = found.agg(F.count("*").alias("regions"), F.count("hit").alias("found"))
    one = t.agg(F.count("*").alias("n_true")).join(p.agg(F.count("*").alias("n_pred"))).join(right).join(counts)  # one row each
    pr, rc = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_true")
    return one.select("regions", "found", "n_true", "n_pred", "tp", F.try_divide("found", "regions").alias("region_recall"), pr.alias("precision"), rc.alias("recall"), F.try_divide(2 * pr * rc, pr + rc).alias("f1"))


def date_matches(day: Column, month: str = "*", dom: str = "*", dow: str = "*") -> Column:
    """Calendar pattern: numbers, `odd`, `even`, `last`, or `*`."""
    one = lambda x, spec, last=None: (
        F.lit(True) if spec == "*" else x % 2 == 1 if spec == "odd" else x % 2 == 0 if spec == "even" else x == last if spec == "last" else x == int(spec)
    )
    return one(F.month(day), month) & one(F.dayofmonth(day), dom, F.dayofmonth(F.last_day(day))) & one(F.weekday(day), dow)


def earned_evidence(activities: DataFrame, links: DataFrame, judged: DataFrame, as_of: Column) -> DataFrame:
    """Activities (activity, finish) by evidence: all linked checks pass, due without evidence, or open."""
    proof = links.join(judged, "check", "left").groupBy("activity").agg(F.bool_and(F.coalesce(F.col("status") == "pass", F.lit(False))).alias("proven"))
    state = (
        F.when(F.col("proven"), "done_by_data")
        .when(F.col("proven").isNull(), "not_linked")
        .when(F.col("finish") <= as_of, "due_not_evidenced")
        .otherwise("open")
    )
    return activities.join(proof, "activity", "left").select("activity", state.alias("state"))


def xer_tables(lines: DataFrame, file_col: str | None = None) -> DataFrame:
    """Rows of a schedule export in tab-separated table form: (table, row, map of fields).

    Lines are (n, line), with a column that names the file where there are several: `%T` names a
    table, `%F` its fields, `%R` is a row. A row needs the lines above it, so a file is one task's work.
    """
    from pyspark.sql.window import Window

    w = (Window.partitionBy(file_col) if file_col else Window.partitionBy()).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    parts = lines.withColumn("f", F.split("line", "\t"))
    table = F.when(F.col("f")[0] == "%T", F.get("f", F.lit(1)))
    fields = F.when(F.col("f")[0] == "%F", F.slice("f", 2, F.size("f") - 1))
    rows = parts.withColumn("table", F.last(table, ignorenulls=True).over(w)).withColumn("fields", F.last(fields, ignorenulls=True).over(w))
    rows = rows.where(F.col("f")[0] == "%R").withColumn("v", F.slice("f", 2, F.size("f") - 1))
    return rows.select(*([file_col] if file_col else []), "table", "n", F.map_from_entries(F.arrays_zip("fields", F.slice("v", 1, F.size("fields")))).alias("row"))
