"""Aggregates over append-only logs: accesses, sessions with primed notes, queries, feedback and run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def access_counts(log: DataFrame) -> DataFrame:
    """mote_id, n, last: accesses and latest access per note; rows without note or time do not count."""
    return log.filter("mote_id is not null and accessed_at is not null").groupBy("mote_id").agg(
        F.count("*").alias("n"), F.max("accessed_at").alias("last")
    )


def flush_accesses(notes: DataFrame, log: DataFrame) -> DataFrame:
    """id, access_count, last_accessed after the log is applied: counts add up, the log's latest access replaces the old one."""
    counts = access_counts(log).select(F.col("mote_id").alias("id"), "n", "last")
    return notes.join(counts, "id", "left").select(
        "id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"), F.coalesce("last", "last_accessed").alias("last_accessed")
    )


def primed_days(log: DataFrame) -> DataFrame:
    """day, mote_id, hit: notes primed on a day, and whether the same day also has an access that was not primed.

    Reduced to one row per day and note before anything else, so no set of a day or of an agent is ever gathered.
    """
    rows = log.filter("mote_id is not null and accessed_at is not null").select(F.to_date("accessed_at").alias("day"), "mote_id", F.coalesce("primed", F.lit(False)).alias("primed"))
    seen = rows.groupBy("day", "mote_id").agg(F.bool_or("primed").alias("primed"), F.bool_or(~F.col("primed")).alias("hit"))
    return seen.filter("primed").select("day", "mote_id", "hit")


def hit_rates(log: DataFrame) -> DataFrame:
    """day, primed_count, hit_count, hit_rate."""
    days = primed_days(log).groupBy("day").agg(F.count("*").alias("primed_count"), F.count(F.when(F.col("hit"), 1)).alias("hit_count"))
    return days.withColumn("hit_rate", F.col("hit_count") / F.col("primed_count"))


def last_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The n latest rows of each key by a unique order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn")


def dominant_notes(log: DataFrame, sessions: int = 10, min_primed: int = 8, below: float = 0.6) -> DataFrame:
    """mote_id, primed, hits: notes primed in at least ``min_primed`` of the last days, but followed up in too few of them."""
    days = primed_days(log)
    recent = days.select("day").distinct().orderBy(F.desc("day")).limit(sessions)
    per_note = days.join(recent, "day", "left_semi").groupBy("mote_id").agg(F.count("*").alias("primed"), F.count(F.when(F.col("hit"), 1)).alias("hits"))
    return per_note.filter((F.col("primed") >= min_primed) & (F.col("hits") / F.col("primed") < below))


def frequent_queries(log: DataFrame, boosted: DataFrame, least: int = 3, boosted_least: int = 2) -> DataFrame:
    """corpus, query, n: queries asked often enough; for those with useful feedback (boosted: corpus, query) fewer suffice."""
    counts = log.groupBy("corpus", "query").agg(F.count("*").alias("n"))
    marked = counts.join(boosted.distinct().withColumn("useful", F.lit(True)), ["corpus", "query"], "left")
    return marked.filter((F.col("n") >= least) | (F.col("useful") & (F.col("n") >= boosted_least))).select("corpus", "query", "n")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per kind (kind, confidence, checked, persisted, delta): totals, and averages over all or over the checked rows."""
    done = F.col("checked")
    per = feedback.groupBy("kind").agg(
        F.count("*").alias("total"), F.count(F.when(done, 1)).alias("checked"), F.count(F.when(done & F.col("persisted"), 1)).alias("persisted"),
        F.count(F.when(done & ~F.col("persisted"), 1)).alias("reverted"), F.sum(F.when(done, F.col("delta"))).alias("deltas"),
        F.count(F.when(done & (F.col("delta") > 0), 1)).alias("positive"), F.avg("confidence").alias("avg_confidence"),
    )
    over = lambda c: F.when(F.col("checked") > 0, F.col(c) / F.col("checked")).otherwise(0.0)
    return per.select("kind", "total", "checked", "persisted", "reverted", over("deltas").alias("avg_delta"), (over("positive") * 100).alias("positive_pct"), "avg_confidence")


def compare_configs(ledger: DataFrame) -> DataFrame:
    """Per config (config, batches, proposals, cost): cycles and means; a cycle without batches counts as 0 per batch, cost per
    proposal averages the cycles that have any."""
    per_batch = F.when(F.col("batches") > 0, F.col("proposals") / F.col("batches")).otherwise(0.0)
    per_proposal = F.when((F.col("proposals") > 0) & (F.col("cost") > 0), F.col("cost") / F.col("proposals"))
    return ledger.groupBy("config").agg(
        F.count("*").alias("cycles"), F.avg(per_batch).alias("avg_per_batch"), F.avg("cost").alias("avg_cost"), F.coalesce(F.avg(per_proposal), F.lit(0.0)).alias("avg_cost_per_proposal")
    )


def visit_pairs(accesses: DataFrame, notes: DataFrame, edges: DataFrame, at_least: int = 2, most: int = 3) -> DataFrame:
    """visit, a, b, n_shared, rank: of each visit (visit, id) the first pairs a < b of notes that share tags and have no edge a -> b.

    Pairs meet on tags within a visit, never on the visit alone.
    """
    tagged = accesses.select("visit", "id").distinct().join(notes.select("id", F.explode(F.array_distinct("tags")).alias("tag")), "id")
    a, b = (tagged.select("visit", "tag", F.col("id").alias(x)) for x in "ab")
    shared = a.join(b, ["visit", "tag"]).filter("a < b").groupBy("visit", "a", "b").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= at_least)
    free = shared.join(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), ["a", "b"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("visit").orderBy("a", "b"))
    return free.withColumn("rank", rank).filter(F.col("rank") <= most).select("visit", "a", "b", "n_shared", "rank")


def tag_suggestions(triggers: DataFrame, tasks: DataFrame, most: int = 3) -> DataFrame:
    """id, task, rank: for each trigger (id, tags) the first tasks (id, tags) by id that share a tag, whatever its case.

    Of a tag only its ``most`` + 1 smallest tasks can be among them, so a tag on very many notes brings no more rows.
    """
    def tags(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag"))

    first = F.row_number().over(Window.partitionBy("tag").orderBy("id"))
    best = tags(tasks).withColumn("place", first).filter(F.col("place") <= most + 1).select("tag", F.col("id").alias("task"))
    met = tags(triggers).join(best, "tag").filter("id <> task").select("id", "task").distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy("task"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most)


def last_flags(rows: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """The key and the flag of its latest row; of rows of one time a true flag counts. Rows without key or time do not."""
    last = F.max(F.struct(order, F.coalesce(flag, F.lit(False)).alias("flag")))
    return rows.filter(F.col(by).isNotNull() & F.col(order).isNotNull()).groupBy(by).agg(last.alias("x")).select(by, F.col("x.flag").alias("flag"))


def run_value(runs: DataFrame) -> DataFrame:
    """One row over a run log (pos, proposals, applied, deferred, cost): sums, acceptance rate, cost of an applied proposal, and
    whether less than a quarter of what the last five runs proposed was applied."""
    recent = runs.orderBy(F.desc("pos")).limit(5).agg(F.sum("applied").alias("a"), F.sum("proposals").alias("p"))
    whole = runs.agg(
        F.count("*").alias("runs"), F.sum("proposals").alias("proposals"), F.sum("applied").alias("applied"), F.sum("deferred").alias("deferred"), F.sum("cost").alias("cost")
    )
    rate = F.when(F.col("proposals") > 0, F.col("applied") / F.col("proposals"))
    each = F.when(F.col("applied") > 0, F.col("cost") / F.col("applied"))
    return whole.crossJoin(recent).select(
        "runs", "proposals", "applied", "deferred", "cost", rate.alias("acceptance"), each.alias("cost_per_applied"),
        F.coalesce(F.when(F.col("p") > 0, F.col("a") / F.col("p") < 0.25), F.lit(False)).alias("low"),
    )
