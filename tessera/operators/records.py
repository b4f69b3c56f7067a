"""Record merge, change log, review queue, failed ingests and job history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import scratch
from tessera.functions import text as T

# merge ---------------------------------------------------------------------------------------------------------------
# Fixed values
STRATEGIES = {
    "title": "keep_existing",
    "domain": "keep_existing",
    "tags": "union",
    "entities": "union",
    "concepts": "union",
    "summary": "prefer_newer",
    "claims": "deduplicate_merge",
    "relationships": "union",
    "source": "keep_existing",
    "created": "keep_existing",
    "updated": "set_to_now",
    "status": "keep_existing",
    "confidence": "prefer_newer",
    "links": "union",
    "sources": "union",
}
ITEM_KEYS = ("name", "claim", "subject", "source_entity", "id")
# End of fixed values


def merge_field(old: Column, new: Column, strategy: str, old_conf: Column, new_conf: Column, keys: tuple[str, ...] | None = None, now: Column | None = None) -> tuple[Column, Column]:
    """(value, conflict). Null new values are skipped; null old ones are filled. union and deduplicate_merge append what is
    not there, in order: plain items by equality, structs by `keys`. Confidences of 0 or null count as 0.5 (old) and 1.0
    (new); prefer_newer replaces when the new one is over 0.1 more, and within 0.1 reports a conflict. set_to_now gives
    `now` where both are there."""
    none = F.lit(False)
    if strategy in ("union", "deduplicate_merge"):
        both = F.concat(old, F.array_except(new, old)) if keys is None else union_by_key(old, new, keys)
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(both), none
    if strategy == "use_extracted":
        return F.coalesce(new, old), none
    if strategy == "set_to_now":
        if now is None:
            raise ValueError("set_to_now needs as_of")
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(now), none
    if strategy == "prefer_newer":
        zero = lambda c, d: F.when(c.isNull() | (c == 0), F.lit(d)).otherwise(c)
        gap = zero(new_conf, 1.0) - zero(old_conf, 0.5)
        differ = old.isNotNull() & new.isNotNull() & (old != new)
        return F.when(new.isNull(), old).when(old.isNull() | (differ & (gap > 0.1)), new).otherwise(old), differ & (F.abs(gap) <= 0.1)
    if strategy != "keep_existing":
        raise ValueError(f"no such strategy: {strategy}")
    return F.coalesce(old, new), none


def integrate(old: DataFrame, new: DataFrame, strategies: dict[str, str] | None = None, as_of: str | None = None) -> DataFrame:
    """page_id, merged fields, n_changes, conflicts: a full outer join by page_id. Fields are those of `strategies` (by
    default of STRATEGIES) that both sides have. as_of: the time that set_to_now gives."""
    plan = {c: s for c, s in (STRATEGIES if strategies is None else strategies).items() if c in old.columns and c in new.columns}
    now = None if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    n = new.select("page_id", *[F.col(c).alias(f"n_{c}") for c in plan])
    both = old.select("page_id", *plan, F.lit(True).alias("__old")).join(n, "page_id", "full")
    values, changed, conflicts = [], F.lit(0), []
    for field, strategy in plan.items():
        item = getattr(old.schema[field].dataType, "elementType", None)
        keys = tuple(k for k in ITEM_KEYS if k in item.names) if isinstance(item, StructType) else None
        value, conflict = merge_field(F.col(field), F.col(f"n_{field}"), strategy, F.col("confidence"), F.col("n_confidence"), keys, now)
        values.append(value.alias(field))
        changed = changed + F.when(F.col("__old") & ~value.eqNullSafe(F.col(field)), 1).otherwise(0)
        conflicts.append(F.when(conflict, F.lit(field)))
    return both.select("page_id", *values, changed.cast("long").alias("n_changes"), F.array_join(F.array_compact(F.array(*conflicts)), ",").alias("conflicts"))


def union_by_key(old: Column, new: Column, keys: tuple[str, ...]) -> Column:
    """Items of new that no item before them equals are appended, in order. Items are equal if no key that both hold (is
    not null in either) differs; so items that share no key are equal."""

    def same(a, b):
        out = F.lit(True)
        for k in keys:
            out = out & F.coalesce(a[k] == b[k], F.lit(True))
        return out

    return F.aggregate(new, old, lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def rolled_back(history: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """history: page_id, seq, ... (an integration a row); chosen: page_id, steps -> the row that each chosen page goes back
    to (the first one, where it goes back past it), and the history without the rows undone. Pages with fewer rows than
    steps give no row and keep theirs."""
    n = history.groupBy("page_id").agg(F.count("*").alias("__n"))
    plan = chosen.select("page_id", "steps").groupBy("page_id").agg(F.max("steps").alias("__steps")).join(n, "page_id").where("__steps between 1 and __n")
    # numbered in ranges of page and seq, so that a page may have any number of rows
    rows = history.join(plan.select("page_id"), "page_id", "left_semi").select("page_id", "seq", F.struct(*history.columns).alias("__row"))
    placed = scratch.numbered(rows, "page_id", "seq")[0].join(plan, "page_id").select("__row.*", F.col("n").alias("__place"), "__n", "__steps")
    left = F.col("__n") - F.col("__steps")
    back = placed.where(F.col("__place") == F.greatest(left, F.lit(1))).select(history.columns)
    kept = history.join(plan, "page_id", "left_anti").select(history.columns).unionByName(placed.where(F.col("__place") <= left).select(history.columns))
    return back, kept


def diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """page_id, field, change, old_value, new_value of the fields that differ."""
    n = new.select("page_id", *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    both = old.select("page_id", *[F.col(f).cast("string").alias(f) for f in fields]).join(n, "page_id", "full")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields])).alias("x")
    out = both.select("page_id", rows).select("page_id", "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("modified")
    return out.select("page_id", "field", change.alias("change"), "old_value", "new_value")


#: How many of each list a page keeps.
MOST_TAGS, MOST_RELATIONSHIPS = 10, 15


def enrich(pages: DataFrame, found: DataFrame, most_tags: int = MOST_TAGS, most_relationships: int = MOST_RELATIONSHIPS) -> DataFrame:
    """found: page_id, tags, summary, kind and, where it has them, entities, concepts, claims and relationships. Kinds and
    summaries are kept, tags united in order and capped; entities, concepts and claims that were found replace a page's;
    relationships are appended, once for each source, type and target of those found, and capped."""
    lists = [c for c in ("entities", "concepts", "claims", "relationships") if c in found.columns]
    f = found.select("page_id", *[F.col(c).alias(f"f_{c}") for c in ("tags", "summary", "kind", *lists)])
    tags = F.slice(F.sort_array(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("f_tags", F.array().cast("array<string>")))), 1, most_tags)
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    new = {"tags": tags, "summary": F.coalesce(given("summary"), "f_summary"), "kind": F.coalesce(given("kind"), "f_kind"), "status": F.lit("enriched")}
    for c in lists:
        kind = found.schema[c].dataType
        old = F.col(c) if c in pages.columns else F.lit(None).cast(kind)
        if c == "relationships":
            key = lambda r: F.struct(*[F.coalesce(r[k], F.lit("")).alias(k) for k in ("source_entity", "relationship_type", "target_entity")])
            keys = F.transform(F.col("f_relationships"), key)
            once = F.filter(F.col("f_relationships"), lambda r, i: F.array_position(keys, key(r)) == i + 1)
            new[c] = F.when(F.size(f"f_{c}") > 0, F.slice(F.concat(F.coalesce(old, F.array().cast(kind)), once), 1, most_relationships)).otherwise(old)
        else:
            new[c] = F.when(F.size(f"f_{c}") > 0, F.col(f"f_{c}")).otherwise(old)
    out = pages.join(f, "page_id", "left").withColumns(new)
    return out.drop(*[c for c in f.columns if c != "page_id"])


# change log ----------------------------------------------------------------------------------------------------------
def with_parents(changes: DataFrame) -> DataFrame:
    """change_id, and parent_id: the page's change before."""
    ident = F.substring(F.sha1(F.concat_ws("::", F.col("page_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("seq").cast("string"))), 1, 16)
    c = changes.withColumn("change_id", ident)
    return c.withColumn("parent_id", F.lag("change_id").over(W.partitionBy("page_id").orderBy("seq")))


def capped(rows: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """The newest rows of each key."""
    w = W.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def page_history(changes: DataFrame, page_id, limit: int = 50) -> DataFrame:
    out = changes.where(F.col("page_id") == page_id).orderBy(F.desc("seq"))
    return out.limit(limit) if limit else out


def recent_changes(changes: DataFrame, since: str, limit: int = 100) -> DataFrame:
    out = changes.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).orderBy(F.desc("ts"), F.desc("seq"))
    return out.limit(limit) if limit else out


def changes_by_actor(changes: DataFrame, actor: str, limit: int = 0) -> DataFrame:
    out = changes.where(F.col("actor") == actor).orderBy(F.desc("ts"), F.desc("seq"))
    return out.limit(limit) if limit else out


def page_diff(changes: DataFrame, page_id, first: str, last: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return changes.where((F.col("page_id") == page_id) & text.between(first, last)).orderBy(F.desc("seq"))


def entry(changes: DataFrame, change_id: str) -> DataFrame:
    """One change by its id; changes as with_parents() gives them."""
    return changes.where(F.col("change_id") == change_id)


def change_lines(diffs: DataFrame, most: int = 120) -> DataFrame:
    """diff()'s rows with `line`: + added, - removed, ~ modified; long values are cut."""
    cut = lambda c: T.truncated(F.col(c), most, "\u2026")
    head = lambda mark: F.concat(F.lit(mark + " "), "field", F.lit(": "))
    line = F.when(F.col("change") == "added", F.concat(head("+"), cut("new_value"))).when(F.col("change") == "removed", F.concat(head("-"), cut("old_value")))
    return diffs.withColumn("line", line.otherwise(F.concat(head("~"), cut("old_value"), F.lit(" -> "), cut("new_value"))))


def change_stats(changes: DataFrame) -> DataFrame:
    """dimension, value, n: totals, by type and by actor, and the ten most changed pages. One scan by grouping sets."""
    c = changes.select(F.col("change_type").alias("t"), F.col("actor").alias("a"), F.col("page_id").cast("string").alias("p"))
    cols = [F.col(x) for x in "tap"]
    sets = c.groupingSets([[x] for x in cols] + [[]], *cols).agg(F.grouping_id().alias("g"), F.coalesce("t", "a", "p").alias("value"), F.count("*").alias("n")).select("g", "value", "n")
    named = sets.select(F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "actor").when(F.col("g") == 6, "page").otherwise("total").alias("dimension"), F.coalesce("value", F.lit("*")).alias("value"), "n")
    top = named.where("dimension = 'page'").orderBy(F.desc("n"), "value").limit(10)
    return named.where("dimension != 'page'").unionByName(top)


# review queue --------------------------------------------------------------------------------------------------------
STATUSES, PRIORITIES = ("pending", "approved", "rejected", "deferred"), ("urgent", "high", "medium", "low")


def review_list(items: DataFrame, status: str | None = None, kind: str | None = None, priority: str | None = None) -> DataFrame:
    """The most urgent first, then the newest."""
    out = items
    for c, v in (("status", status), ("type", kind), ("priority", priority)):
        out = out if v is None else out.where(F.col(c) == v)
    return out.orderBy(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")), F.desc("created_at"), "id")


def review_get(items: DataFrame, item_id: str, status: str | None = None) -> DataFrame:
    """The item of an id; should several statuses hold it, the first of them in their order."""
    own = items.where(F.col("id") == item_id)
    own = own if status is None else own.where(F.col("status") == status)
    return own.orderBy(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))).limit(1)


def review_counts(items: DataFrame) -> DataFrame:
    """status, n: zero where there are none."""
    every = items.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(items.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def review_stats(items: DataFrame) -> DataFrame:
    one = F.col("status") == "pending"
    return items.agg(F.count("*").alias("total"), F.count_if(one).alias("pending"), *[F.count_if(one & (F.col("priority") == p)).alias(f"pending_{p}") for p in PRIORITIES])


# Kinds of review items
KINDS = ("page", "claim", "contradiction", "promotion", "duplicate", "routing_mistake", "sourceless_claim", "manual")
# End of fixed values


def review_totals(items: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """what, name, n: items by status, pending ones by priority and by type, and totals; zero where there are none."""
    pending = F.col("status") == "pending"
    rows = [("status", s, F.count_if(F.col("status") == s)) for s in STATUSES]
    rows += [("pending_by_priority", p, F.count_if(pending & (F.col("priority") == p))) for p in PRIORITIES]
    rows += [("pending_by_type", k, F.count_if(pending & (F.col("type") == k))) for k in kinds]
    rows += [("total", "pending", F.count_if(pending)), ("total", "all", F.count_if(F.col("status").isin(*STATUSES)))]
    counted = items.agg(F.array(*[F.struct(F.lit(w).alias("what"), F.lit(n).alias("name"), c.alias("n")) for w, n, c in rows]).alias("x"))
    return counted.select(F.inline("x"))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: id, decision, reviewer, at, notes. Only pending items change; a deferral sets no review time."""
    d = decisions.select("id", "decision", "reviewer", "at", F.col("notes").alias("d_notes"))
    act = (F.col("status") == "pending") & F.col("decision").isNotNull()
    settled = act & (F.col("decision") != "deferred")
    return (
        items.join(d, "id", "left")
        .withColumns({"reviewed_at": F.when(settled, F.col("at")).otherwise(F.col("reviewed_at")), "reviewed_by": F.when(act, F.col("reviewer")).otherwise(F.col("reviewed_by")), "notes": F.when(act, F.col("d_notes")).otherwise(F.col("notes")), "status": F.when(act, F.col("decision")).otherwise(F.col("status"))})
        .drop("decision", "reviewer", "at", "d_notes")
    )


def review_put(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items created or updated: a new row replaces the one of its id and status. Of new rows with one id and status the
    latest stays."""
    latest = W.partitionBy("id", "status").orderBy(F.desc("created_at"))
    once = new.withColumn("__r", F.row_number().over(latest)).where("__r = 1").select(items.columns)
    return items.join(once.select("id", "status"), ["id", "status"], "left_anti").select(items.columns).unionByName(once)


def review_delete(items: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: id and, if it has one, status."""
    by = [c for c in ("id", "status") if c in gone.columns]
    return items.join(gone.select(by), by, "left_anti").select(items.columns)


def review_cleanup(items: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return items.where(~F.coalesce(F.col("reviewed_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))


def review_fan_in(pairs: DataFrame, queued: DataFrame, as_of: str, least: float = 0.5, most: int = 20) -> DataFrame:
    """New review items of duplicate pairs that are not queued in either order."""
    p = pairs.where(F.col("score") >= least).select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b"), "score")
    q = queued.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b"))
    priority = F.when(F.col("score") > 0.8, "high").when(F.col("score") >= 0.6, "medium").otherwise("low")
    return p.join(q, ["a", "b"], "left_anti").orderBy(F.desc("score"), "a", "b").limit(most).select(F.concat_ws("|", "a", "b").alias("target_id"), F.lit("duplicate").alias("type"), priority.alias("priority"), F.lit("pending").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


# failed ingests ------------------------------------------------------------------------------------------------------
def failures(attempts: DataFrame, max_retries: int = 5) -> DataFrame:
    """attempts: file_path, at, error -> the state of each file: count, last reason, permanent, next_retry."""
    a = attempts.withColumn("reason", T.failure_reason(F.col("error")))
    state = a.groupBy("file_path").agg(F.count("*").alias("failure_count"), F.max("at").alias("last_attempt"), F.max_by("reason", F.struct("at", "error")).alias("reason"), F.max(F.col("reason").isin(*T.PERMANENT)).alias("ever_permanent"))
    permanent = F.col("ever_permanent") | (F.col("failure_count") >= max_retries)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), T.retry_seconds(F.col("failure_count")))
    return state.select("file_path", "failure_count", "last_attempt", "reason", permanent.alias("permanent"), F.when(~permanent, F.col("last_attempt") + wait).alias("next_retry"))


def retryable(state: DataFrame, as_of: str, max_retries: int = 5) -> DataFrame:
    return state.where(~F.col("permanent") & (F.col("failure_count") < max_retries) & (F.col("next_retry") <= F.lit(as_of).cast("timestamp_ntz")))


def permanent(state: DataFrame) -> DataFrame:
    """The failed files that are given up."""
    return state.where("permanent")


def failed(state: DataFrame, file_path: str) -> DataFrame:
    """One file's state; no row if it has not failed."""
    return state.where(F.col("file_path") == file_path)


def failure_stats(state: DataFrame, as_of: str) -> DataFrame:
    ready = ~F.col("permanent") & (F.col("next_retry") <= F.lit(as_of).cast("timestamp_ntz"))
    return state.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("permanent").alias("n_permanent"), F.count_if(F.col("reason").isin(*T.TRANSIENT)).alias("n_transient"), F.count_if(ready).alias("n_retryable"))


# jobs ----------------------------------------------------------------------------------------------------------------
def job_stats(executions: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """Per job: counts by status, success rate, mean duration, the last run, failures in the trailing window."""
    s, at = F.col("status"), F.lit(as_of).cast("timestamp_ntz")
    late = (s == "failed") & (F.col("started_at") > at - F.expr(f"INTERVAL {minutes} MINUTES"))
    last = F.max_by(F.struct("status", "started_at"), "execution_id").alias("last")
    out = executions.groupBy("job_name").agg(
        F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.avg("duration_seconds").alias("avg_duration"), F.count_if(late).alias("recent_failures"), last
    )
    return out.select("job_name", "total", "completed", "failed", (F.col("completed") / F.col("total")).alias("success_rate"), "avg_duration", "recent_failures", F.col("last.status").alias("last_status"), F.col("last.started_at").alias("last_started"))


def job_history(executions: DataFrame, job: str | None = None, most: int = 10) -> DataFrame:
    """The last `most` runs of one job, or of each, the latest first. Each task keeps its own `most` of a job."""
    out = executions if job is None else executions.where(F.col("job_name") == job)
    last = W.partitionBy("job_name").orderBy(F.desc("started_at"), F.desc("execution_id"))
    return out.withColumn("place", F.row_number().over(last)).where(F.col("place") <= most)


def jobs(executions: DataFrame) -> DataFrame:
    return executions.select("job_name").distinct()


NAMES = {n: i + 1 for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
DAYS = {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}


def _cron(expression: str) -> list[set[int]]:
    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    fields = expression.lower().split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    out = []
    for no, (field, (lo, hi)) in enumerate(zip(fields, bounds)):
        number = lambda x: {3: NAMES, 4: DAYS}.get(no, {}).get(x) if x in {3: NAMES, 4: DAYS}.get(no, {}) else int(x)  # noqa: E731, B023
        allowed: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            first, last = (lo, hi) if span == "*" else (number(span.split("-")[0]), number(span.split("-")[-1]) if "-" in span or not step else hi)
            if not lo <= first <= last <= hi:
                raise ValueError(f"out of range: {part}")
            allowed |= set(range(first, last + 1, int(step or 1)))
        out.append({x % 7 for x in allowed} if no == 4 else allowed)
    return out


def _cron_match(t: Column, expression: str) -> Column:
    minute, hour, day, month, weekday = (sorted(s) for s in _cron(expression))
    return F.minute(t).isin(minute) & F.hour(t).isin(hour) & F.dayofmonth(t).isin(day) & F.month(t).isin(month) & (F.dayofweek(t) - 1).isin(weekday)


def cron_matches(rows: DataFrame, at: str, expression: str) -> DataFrame:
    """The rows whose time lies in a minute that the expression names; day and weekday must both match."""
    return rows.where(_cron_match(F.col(at), expression))


def cron_runs(spark, expression: str, start: str, end: str) -> DataFrame:
    """run_at of each minute in [start, end) that matches; day and weekday must both."""
    t = F.col("run_at")
    every = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 MINUTE"))).alias("run_at"))
    return every.where((t < F.lit(end).cast("timestamp_ntz")) & _cron_match(t, expression))


# extraction ----------------------------------------------------------------------------------------------------------
def queue_stats(items: DataFrame) -> DataFrame:
    """items: domain, status -> domain, processed, failed, skipped."""
    return items.groupBy("domain").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "failed", "skipped")])


def extraction_totals(found: DataFrame, fields: tuple[str, ...] = ("entities", "concepts", "claims", "relationships")) -> DataFrame:
    """page_id, the number of items of each array, their total, and whether there are any."""
    n = {f: F.coalesce(F.size(F.coalesce(F.col(f), F.array().cast(found.schema[f].dataType))), F.lit(0)) for f in fields}
    total = sum(n.values(), F.lit(0))
    return found.select("page_id", *[c.cast("long").alias(f"n_{f}") for f, c in n.items()], total.cast("long").alias("total"), (total > 0).alias("found_any"))


def validated(answers: DataFrame, column: str, item: str, required: tuple[str, ...], most: int) -> DataFrame:
    """answers with `column`, a model's JSON array as text, parsed: items are structs of the DDL `item`; those without a
    required field, or with a confidence outside 0 to 1, go; the first `most` stay. Text that is no such array gives none."""
    parsed = F.from_json(column, f"array<struct<{item}>>")
    names = {f.strip().replace(":", " ").split()[0] for f in item.split(",")}

    def valid(x):
        ok = x.isNotNull()
        for k in required:
            ok = ok & (F.trim(F.coalesce(x[k].cast("string"), F.lit(""))) != "")
        return ok & F.coalesce(x["confidence"].between(0, 1), F.lit(True)) if "confidence" in names else ok

    none = F.array().cast(f"array<struct<{item}>>")
    return answers.withColumn(column, F.coalesce(F.slice(F.filter(parsed, valid), 1, most), none))


def filled(pages: DataFrame, model: dict[str, Column]) -> DataFrame:
    """pages with what is missing (null, blank, an empty array) taken from a caller's model: columns over the page, such as
    calls of a pandas UDF. What a page has is kept; a column that pages lack is added."""

    def value(name, found):
        if name not in pages.columns:
            return found
        old = F.col(name)
        empty = F.size(old) == 0 if pages.schema[name].dataType.typeName() == "array" else F.trim(old.cast("string")) == ""
        return F.when(old.isNull() | empty, found).otherwise(old)

    return pages.withColumns({name: value(name, found) for name, found in model.items()})


def qa_pages(pairs: DataFrame) -> DataFrame:
    """pairs: page_id, domain, question, answer -> one draft page of kind qa a pair, linked to its page. Ids are numbered
    within a page, in order of the question, so that none collide."""
    n = F.row_number().over(W.partitionBy("page_id").orderBy("question", "answer"))
    ident = F.concat_ws("-", F.col("page_id").cast("string"), F.lit("qa"), n.cast("string"))
    body = F.concat(F.lit("## Question\n\n"), "question", F.lit("\n\n## Answer\n\n"), "answer", F.lit("\n\n[["), F.col("page_id").cast("string"), F.lit("]]\n"))
    return pairs.select(ident.alias("page_id"), F.lit("qa").alias("kind"), F.col("question").alias("title"), "domain", F.lit("draft").alias("status"), F.lit(0.6).alias("confidence"), body.alias("body"))
