"""Session state in batch: turns, marks, drafts, merged pieces, expiry.

Every order-dependent value is a window over (session_id, seq); nothing relies
on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import atoms
from tracewell.operators import policy as G

USER_ATOMS = 500
#: Rows whose text names what the user means.
SPEAKS = "role IN ('user', 'task')"
DRAFT_CHARS = 200_000
SESSION_TTL_S, DRAFT_TTL_S = 24 * 3600, 3600


def turns(events: DataFrame) -> DataFrame:
    """``events`` (session_id, seq, role) with turn: prompts seen so far."""
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(order).cast("long"))


def exposures(events: DataFrame) -> DataFrame:
    """``events`` of :func:`turns` with exposure: the label of the last untrusted
    read since the last prompt and before the event."""
    order = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("exposure", F.last(F.when(F.col("untrusted"), F.col("label")), ignorenulls=True).over(order))


def unredacted(events: DataFrame) -> DataFrame:
    """``events`` of :func:`turns` with unredacted: whether a read since the last
    prompt could not be cleaned (column uncleaned)."""
    order = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("unredacted", F.coalesce(F.max(F.col("uncleaned").cast("int")).over(order), F.lit(0)) > 0)


def last_sources(events: DataFrame) -> DataFrame:
    """``events`` with last_source: the last untrusted label of the session."""
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("last_source", F.last(F.when(F.col("untrusted"), F.col("label")), ignorenulls=True).over(order))


def user_atoms(events: DataFrame, most: int = USER_ATOMS) -> DataFrame:
    """(session_id, atoms): what the user named, in order of first mention, the
    last ``most``.

    Each prompt's tokens are exploded and the first mention found by aggregation,
    so no row carries the tokens of all prompts before it.
    """
    said = events.filter(SPEAKS).select("session_id", "seq", F.posexplode(atoms(F.col("text"))).alias("k", "atom"))
    first = said.groupBy("session_id", "atom").agg(F.min(F.struct("seq", "k")).alias("first"))
    late = Window.partitionBy("session_id").orderBy(F.desc("first"))
    kept = first.withColumn("_rank", F.row_number().over(late)).filter(F.col("_rank") <= most)
    listed = kept.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("first", "atom"))).alias("l"))
    return listed.select("session_id", F.transform("l", lambda x: x["atom"]).alias("atoms"))


def user_atoms_so_far(events: DataFrame, most: int = USER_ATOMS) -> DataFrame:
    """``events`` of :func:`turns` with user_atoms: what the user had named by
    then, in order, the last ``most`` after each prompt; what fell out and is
    named again comes in anew.

    Prompts are folded once a session, and a session's turns meet their list in
    a join, so no event carries another's text.
    """
    said = events.filter(SPEAKS).select("session_id", F.struct("seq", "turn", atoms(F.col("text")).alias("named")).alias("p"))
    every = said.groupBy("session_id").agg(F.sort_array(F.collect_list("p")).alias("l"))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("now"), F.array().cast("array<struct<seq: bigint, upto: array<string>>>").alias("past"))

    def step(state: Column, p: Column) -> Column:
        named = F.concat(state["now"], F.array_except(p["named"], state["now"]))
        now = F.slice(named, F.greatest(F.size(named) - most + 1, F.lit(1)), F.lit(most))
        return F.struct(now.alias("now"), F.concat(state["past"], F.array(F.struct(p["seq"].cast("long").alias("seq"), now.alias("upto")))).alias("past"))

    lists = every.select("session_id", F.explode(F.aggregate("l", zero, step)["past"]).alias("x")).select("session_id", F.col("x.seq").alias("_said"), "x.upto")
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.withColumn("_said", F.last(F.when(F.expr(SPEAKS), F.col("seq").cast("long")), ignorenulls=True).over(order))
    return placed.join(lists, ["session_id", "_said"], "left").withColumn("user_atoms", F.coalesce("upto", none)).drop("_said", "upto")


def declared(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """``events`` after the tasks (session_id, text) that were declared for their
    sessions: what a task names counts as named by the user, but begins no turn."""
    first = tasks.select("session_id", F.lit(-1).cast(events.schema["seq"].dataType).alias("seq"), F.lit("task").alias("role"), "text")
    return first.unionByName(events, allowMissingColumns=True)


def directives(events: DataFrame) -> DataFrame:
    """``events`` of :func:`turns` with directive: the classes that the latest
    prompt asks for; null where it asks for none or for none that is known."""
    order = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    asked = G.directive(F.col("text"))
    known = F.when((F.col("role") == "user") & (F.size(asked) > 0), asked)
    return events.withColumn("directive", F.first(known).over(order))


def folded(events: DataFrame, most: int = USER_ATOMS) -> DataFrame:
    """``events`` (session_id, seq, role, text, untrusted, label, uncleaned) with
    a session's whole state as of each: turn, exposure, last_source, unredacted,
    directive and user_atoms.

    All windows share one partitioning, by session; only the lists of what users
    named are joined.
    """
    return user_atoms_so_far(directives(unredacted(last_sources(exposures(turns(events))))), most)


def drafts(deltas: DataFrame) -> DataFrame:
    """(session_id, message_id, text, complete): messages put together from
    deltas (seq, delta, final), at most :data:`DRAFT_CHARS`."""
    order = Window.partitionBy("session_id", "message_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = deltas.withColumn("_before", F.coalesce(F.sum(F.length("delta")).over(order), F.lit(0)))
    shown = F.when(F.col("_before") < DRAFT_CHARS, F.struct("seq", "delta"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["delta"]), "")
    found = placed.groupBy("session_id", "message_id").agg(joined.alias("text"), F.max("final").alias("complete"))
    return found.withColumn("text", F.substring("text", 1, DRAFT_CHARS))


def merged_state(pieces: DataFrame) -> DataFrame:
    """Pieces of a session (piece, turn, unredacted, directive, exposure,
    user_atoms) merged to the stricter reading.

    The highest turn, any mark, the directives' intersection (null is none),
    the first exposure by name of piece, the union of what the user named.
    """
    listed = pieces.groupBy("session_id").agg(
        F.max("turn").alias("turn"),
        F.max("unredacted").alias("unredacted"),
        F.min_by("exposure", F.when(F.col("exposure").isNotNull(), F.col("piece"))).alias("exposure"),
        F.sort_array(F.collect_list(F.struct("piece", "directive", "user_atoms"))).alias("l"),
    )
    named = F.filter(F.transform("l", lambda x: x["directive"]), lambda d: d.isNotNull())
    both = F.aggregate(named, F.get(named, F.lit(0)), lambda a, d: F.array_intersect(a, d))
    every = F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["user_atoms"], F.array().cast("array<string>")))))
    last = F.slice(every, F.greatest(F.size(every) - USER_ATOMS + 1, F.lit(1)), F.lit(USER_ATOMS))
    return listed.select("session_id", "turn", "unredacted", "exposure", both.alias("directive"), last.alias("user_atoms"))


def whole_seconds(at: Column) -> Column:
    """Seconds since 1970, rounded down before it too, where ``unix_timestamp``
    rounds up."""
    return F.unix_timestamp(at - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), at) % 1))


def expired(last_seen: DataFrame, now: Column, ttl_s: int, keep: str | None = None, budget: int | None = 5000) -> DataFrame:
    """Sessions whose last event is ``ttl_s`` old or older, the oldest ``budget``
    (of each directory, where there is a column directory), or all if it is None."""
    old = last_seen.filter((whole_seconds(now) - whole_seconds(F.col("last_ts")) >= ttl_s) & (F.lit(keep is None) | (F.col("session_id").cast("string") != F.lit(keep))))
    if budget is None:
        return old
    if "directory" in old.columns:
        rank = F.row_number().over(Window.partitionBy("directory").orderBy("last_ts", "session_id"))
        return old.withColumn("_rank", rank).filter(F.col("_rank") <= budget).drop("_rank")
    return old.orderBy("last_ts", "session_id").limit(budget)


def resubmitted(messages: DataFrame) -> DataFrame:
    """``messages`` with submit: whether (idx, text) differs from the one before."""
    order = Window.partitionBy("session_id").orderBy("seq")
    same = F.lag("idx").over(order).eqNullSafe(F.col("idx")) & F.lag("text").over(order).eqNullSafe(F.col("text"))
    return messages.withColumn("submit", ~same)
