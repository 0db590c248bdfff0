"""Alerts, reviews and corrective actions as append-only events folded into current state.

Folds are aggregates keyed by id, merged before the shuffle, so an id holding a third of all
events is folded by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazlake.functions.ids import content_id
from hazlake.functions.numbers import percent
from hazlake.functions.text import excerpt, strip

ALERT_STATUSES = ("NEW", "ACKNOWLEDGED", "RESOLVED")
ACTION_STATUSES = ("OPEN", "IN_PROGRESS", "COMPLETED", "VERIFIED")
PRIORITIES = ("IMMEDIATE", "HIGH", "MEDIUM", "ROUTINE")
DEFAULT_CONTROL = "Begin an emergency inspection and secure the area at once."
DEFAULT_COMMENT = "Classification checked and accepted by the safety officer."
DEFAULT_REJECTION = "Marked as a false positive by the safety officer."
DEFAULT_TASK = "Carry out the control for this hazard."
#: Widths of the time slices that action events are folded in, from fine to coarse.
SLICES = ("hour", "month")


# ---- access -----------------------------------------------------------------------------------

def is_officer(role: Column) -> Column:
    return F.coalesce(F.lower(strip(role)) == "officer", F.lit(False))


def role_gate(events: DataFrame, role: str = "role") -> DataFrame:
    """Add ``accepted`` and, for turned-down events, the reason."""
    allowed = is_officer(F.col(role))
    return events.withColumn("accepted", allowed).withColumn(
        "rejection", F.when(~allowed, "Only safety officers may do this.")
    )


def known_targets(events: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Events whose target exists."""
    return events.join(targets.select(key), key, "left_semi")


def unknown_targets(events: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Events aimed at an id nobody created."""
    return events.join(targets.select(key), key, "left_anti")


# ---- alerts -----------------------------------------------------------------------------------

def generate_alerts(
    scored: DataFrame, text: str, level: str, location: str, department: str, created: Column | None = None
) -> DataFrame:
    """A new alert for every HIGH or CRITICAL report, as a whole record.

    ``created`` is the time of the analysis, by default now. The fields of the audit trail start as null.
    """
    created = F.current_timestamp() if created is None else created
    nobody = F.lit(None).cast("string")
    first_action = F.try_element_at("corrective_actions", F.lit(1))
    control = F.coalesce(
        F.nullif(first_action["immediate_control"], F.lit("")),
        F.nullif(first_action["action"], F.lit("")),
        F.try_element_at("recommended_actions", F.lit(1)),
        F.lit(DEFAULT_CONTROL),
    )
    return scored.filter(F.col("tier").isin("HIGH", "CRITICAL")).select(
        content_id("ALT-", F.col("report_id"), F.col(text), F.lit("alert")).alias("alert_id"),
        "report_id",
        created.alias("timestamp"),
        F.col("tier").alias("risk_level"),
        F.col("score").alias("risk_score"),
        F.col("labels").alias("detected_precursors"),
        F.coalesce(F.col(level), F.lit("III")).alias("severity_level"),
        control.alias("recommended_immediate_action"),
        F.lit("NEW").alias("alert_status"),
        F.coalesce(F.nullif(F.col(location), F.lit("")), F.lit("Field Site")).alias("location"),
        F.coalesce(F.nullif(F.col(department), F.lit("")), F.lit("Mining")).alias("department"),
        excerpt(F.col(text)).alias("observation_excerpt"),
        nobody.alias("acknowledged_by"),
        nobody.alias("resolved_by"),
        nobody.alias("reviewer_notes"),
        created.alias("updated_at"),
    )


def current_records(records: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Records as their events have left them: fields of the state replace those of the record, if there are events.

    A record without events keeps its own fields. A null in the state is taken over, since a fold may clear a field.
    """
    changed = [c for c in state.columns if c != key]
    folded = state.select(F.col(key), F.struct(*changed).alias("_state"))
    joined = records.join(folded, key, "left")
    return joined.select(
        *[
            F.when(F.col("_state").isNotNull(), F.col(f"_state.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in records.columns
        ]
    )


def officer_tag(name: Column, badge: Column) -> Column:
    name, badge = F.nullif(name, F.lit("")), F.nullif(badge, F.lit(""))
    return F.coalesce(
        F.when(name.isNotNull() & badge.isNotNull(), F.concat(name, F.lit(" ("), badge, F.lit(")"))),
        name,
        badge,
        F.lit("Safety Officer"),
    )


def valid_status(events: DataFrame, status: str, allowed: tuple[str, ...]) -> DataFrame:
    """Events with a known status, in its normal form."""
    return events.withColumn(status, F.upper(strip(F.col(status)))).filter(F.col(status).isin(*allowed))


def alert_state(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Current state per alert from its status events.

    The first to resolve counts as acknowledging too, unless someone acknowledged: any later
    acknowledgement replaces the tag, so the last one wins, else the first resolution.
    """
    moves = valid_status(events, "status", ALERT_STATUSES)
    at = F.struct(*order)
    tag = officer_tag(F.col("officer_name"), F.col("officer_id"))

    def when(condition: Column) -> Column:
        return F.when(condition, at)

    acked = F.col("status") == "ACKNOWLEDGED"
    done = F.col("status") == "RESOLVED"
    return moves.groupBy("alert_id").agg(
        F.max_by("status", at).alias("alert_status"),
        F.max(order[0]).alias("updated_at"),
        F.max_by("notes", when(F.col("notes").isNotNull())).alias("reviewer_notes"),
        F.max_by(tag, when(done)).alias("resolved_by"),
        F.coalesce(F.max_by(tag, when(acked)), F.min_by(tag, when(done))).alias("acknowledged_by"),
    )


def _deciding(events: DataFrame, key: str, choices: list[Column]) -> DataFrame:
    """The chosen events of each id, without repeats; each choice is a struct or null."""
    picked = F.array_distinct(F.array_compact(F.array(*[F.col(f"_c{i}") for i in range(len(choices))])))
    folded = events.groupBy(key).agg(*[c.alias(f"_c{i}") for i, c in enumerate(choices)])
    return folded.select(key, F.inline(picked))


def compact_alert_events(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """At most five events per alert that give the same state as all of them."""
    moves = valid_status(events, "status", ALERT_STATUSES)
    at, row = F.struct(*order), F.struct(*[c for c in moves.columns if c != "alert_id"])
    done = F.when(F.col("status") == "RESOLVED", at)
    choices = [
        F.max_by(row, at),
        F.max_by(row, F.when(F.col("notes").isNotNull(), at)),
        F.max_by(row, F.when(F.col("status") == "ACKNOWLEDGED", at)),
        F.min_by(row, done),
        F.max_by(row, done),
    ]
    return _deciding(moves, "alert_id", choices)


def alert_counters(state: DataFrame, status: str | None = None) -> DataFrame:
    current = F.upper(strip(F.col("alert_status")))
    matching = F.lit(True) if status is None else current == status.strip().upper()
    return state.agg(
        F.count("*").alias("total_store_count"),
        F.count_if(matching).alias("matching"),
        *[F.count_if(current == s).alias(f"{s.lower()}_count") for s in ALERT_STATUSES],
    )


# ---- reading back -----------------------------------------------------------------------------

def newest_first(df: DataFrame, time_col: str, tie: str, limit: int) -> DataFrame:
    """Latest rows; each task keeps its own best, so nothing is sorted as a whole."""
    return df.orderBy(F.desc(time_col), tie).limit(limit)


def where_equal(df: DataFrame, upper: bool = True, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            target = value.strip().upper() if upper else value.strip()
            df = df.filter(F.col(column) == target)
    return df


def search(df: DataFrame, query: str, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows where the query occurs, in any case, in one of the columns or array items."""
    q = query.strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(c, lambda v: F.contains(F.lower(v), F.lit(q))), F.lit(False))
    return df.filter(hit)


ALERT_SEARCH = ["alert_id", "location", "department", "observation_excerpt", "risk_level", "recommended_immediate_action"]
ACTION_SEARCH = [
    "action_id", "report_id", "action_description", "responsible_role", "tracking_notes", "priority",
    "ai_generated_context.related_precursor", "ai_generated_context.immediate_control",
]


def lookup_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted ids with their records; ``found`` is false where there is none."""
    return wanted.join(df.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


# ---- reviews ----------------------------------------------------------------------------------

def validate_reviews(events: DataFrame) -> DataFrame:
    """Add the normal ``decision``, the final ``officer_comment`` and an ``error``, null if valid."""
    raw = F.upper(strip(F.coalesce(F.col("review_status"), F.lit(""))))
    decision = (
        F.when(raw.isin("ACCEPT", "ACCEPTED"), "ACCEPTED")
        .when(raw.isin("MODIFY", "MODIFIED"), "MODIFIED")
        .when(raw.isin("REJECT", "REJECTED"), "REJECTED")
    )
    comment = strip(F.coalesce(F.col("comment"), F.lit("")))

    def blank(c: str) -> Column:
        return strip(F.coalesce(F.col(c), F.lit(""))) == ""

    error = (
        F.when(blank("officer_name"), "A review needs an officer name.")
        .when(blank("officer_id"), "A review needs an officer id.")
        .when(~F.col("has_prediction"), "There is no prediction to review.")
        .when(
            F.col("decision").isNull(),
            F.concat(
                F.lit("Unknown decision '"), F.coalesce(F.col("review_status"), F.lit("")),
                F.lit("': use ACCEPTED, MODIFIED or REJECTED."),
            ),
        )
        .when(
            F.col("decision").isin("MODIFIED", "REJECTED") & (F.length("officer_comment") < 3),
            F.concat(
                F.lit("A comment is needed where the officer has "), F.col("decision"),
                F.lit(" the prediction."),
            ),
        )
    )
    return (
        events.withColumn("decision", decision)
        .withColumn("officer_comment", comment)
        .withColumn("error", error)
        .withColumn(
            "officer_comment",
            F.when((F.col("decision") == "ACCEPTED") & (F.col("officer_comment") == ""), DEFAULT_COMMENT).otherwise(
                F.col("officer_comment")
            ),
        )
    )


def prediction_snapshot(df: DataFrame, level: list[str], score: list[str]) -> DataFrame:
    """Level and score under review: nested value first, then the flat one. Zero falls through."""
    return df.withColumn(
        "ai_severity", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in level], F.lit("I"))
    ).withColumn("ai_risk_score", F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in score], F.lit(0)))


def decide_reviews(valid: DataFrame) -> DataFrame:
    """Final decision per review.

    Accepted keeps the prediction. Rejected takes the officer's values or the harmless defaults.
    Modified takes the officer's values or the prediction.
    """
    accepted = F.col("decision") == "ACCEPTED"
    rejected = F.col("decision") == "REJECTED"

    def pick(human: str, ai: Column, harmless: Column) -> Column:
        given = F.col(human)
        return (
            F.when(accepted, ai)
            .when(rejected, F.coalesce(given, harmless))
            .otherwise(F.coalesce(given, ai))
        )

    none = F.array().cast("array<string>")
    out = valid.withColumns(
        {
            "final_severity": pick("human_severity", F.col("ai_severity"), F.lit("I")),
            "final_risk_score": pick("human_score", F.col("ai_risk_score"), F.lit(0)),
            "final_risk_level": pick("human_level", F.coalesce("ai_risk_level", F.lit("LOW")), F.lit("LOW")),
            "final_precursors": pick("human_precursors", F.col("ai_precursors"), none),
            "final_actions": pick("human_actions", F.col("ai_actions"), F.array(F.lit(DEFAULT_REJECTION))),
        }
    )
    return out.withColumn(
        "officer_modified_severity", F.when(F.col("decision") != "ACCEPTED", F.col("final_severity"))
    )


# ---- corrective actions -----------------------------------------------------------------------

CONTEXT_FIELDS = (
    "precursor_id", "related_precursor", "immediate_control", "verification_step", "escalation_condition",
    "follow_up_action", "reason",
)
CONTEXT = "struct<" + ",".join(f"{f}:string" for f in CONTEXT_FIELDS) + ">"


def create_actions(requests: DataFrame) -> DataFrame:
    """Requests as new OPEN actions with all fields of a record; ``error`` says why one is turned down.

    A request may bring its own ``action_id``, ``created_at``, ``due_date`` and ``ai_generated_context``. Otherwise the
    id is a digest of report, ``position`` (if there is one) and description, the time is now, and the others are null.
    """
    def blank(c: str) -> Column:
        return strip(F.coalesce(F.col(c), F.lit(""))) == ""

    given = {
        "created_at": F.current_timestamp(),
        "due_date": F.lit(None).cast("string"),
        "ai_generated_context": F.lit(None).cast(CONTEXT),
    }
    requests = requests.withColumns({c: v for c, v in given.items() if c not in requests.columns})
    time = requests.schema["created_at"].dataType
    priority = F.upper(strip(F.coalesce(F.col("priority"), F.lit("HIGH"))))
    made = requests.withColumn(
        "error",
        F.when(blank("report_id"), "An action needs a report id.").when(
            blank("action_description"), "An action needs a description."
        ),
    ).withColumns(
        {
            "report_id": strip(F.col("report_id")),
            "action_description": strip(F.col("action_description")),
            "priority": F.when(priority.isin(*PRIORITIES), priority).otherwise("HIGH"),
            "responsible_role": F.when(blank("responsible_role"), "Safety Officer").otherwise(
                strip(F.col("responsible_role"))
            ),
            "status": F.lit("OPEN"),
            "verification_status": F.lit("UNVERIFIED"),
            "updated_at": F.col("created_at"),
            "completed_at": F.lit(None).cast(time),
            "verified_at": F.lit(None).cast(time),
            "verified_by_officer": F.lit(None).cast("string"),
            "officer_id": F.lit(None).cast("string"),
            "tracking_notes": F.lit(None).cast("string"),
        }
    )
    if "action_id" in requests.columns:
        return made
    keys = [F.col(c) for c in ("report_id", "position", "action_description") if c in made.columns]
    return made.withColumn("action_id", F.when(F.col("error").isNull(), content_id("ACT-", *keys)))


def register_actions(
    analysed: DataFrame, report_id: str = "report_id", created: Column | None = None, due: Column | None = None
) -> DataFrame:
    """One tracked action per corrective action of a report, in order, with its context kept.

    ``created`` and ``due`` are columns of ``analysed``: the time of the analysis (default now) and a due date.
    """
    item = F.col("a")
    made = (F.current_timestamp() if created is None else created).alias("created_at")
    until = (F.lit(None) if due is None else due).cast("string").alias("due_date")
    told = analysed.select(report_id, made, until, F.posexplode("corrective_actions").alias("position", "a"))
    requests = told.select(
        F.col(report_id).alias("report_id"),
        "position",
        "created_at",
        "due_date",
        F.coalesce(
            F.nullif(item["action"], F.lit("")), F.nullif(item["immediate_control"], F.lit("")), F.lit(DEFAULT_TASK)
        ).alias("action_description"),
        item["priority"].alias("priority"),
        F.coalesce(F.nullif(item["responsible_safety_role"], F.lit("")), F.lit("Process Safety Lead")).alias(
            "responsible_role"
        ),
        F.struct(
            *[item[f].alias(f) for f in CONTEXT_FIELDS]
        ).alias("ai_generated_context"),
    )
    return create_actions(requests)


def attach_tracking(analysed: DataFrame, tracked: DataFrame, report_id: str = "report_id") -> DataFrame:
    """Corrective actions beside their tracked records, matched by report and position."""
    plain = analysed.select(report_id, F.posexplode("corrective_actions").alias("position", "a"))
    records = tracked.select(
        report_id, "position", "action_id", "status", "verification_status", "responsible_role"
    )
    return plain.join(records, [report_id, "position"], "left")


def _slice_summaries(events: DataFrame, key: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """One row ``(key, _slice, _sum)`` per id and time slice, where ``_sum`` holds the few events that decide a state.

    The events of a busy id are dealt by time, so each task folds one slice of it. The last OPEN of a slice is found in
    a window that spills; the aggregate over it has the same keys and needs no further shuffle.
    """
    moves = valid_status(events, status, ACTION_STATUSES)
    row = F.struct(F.struct(*order).alias("at"), F.struct(*[c for c in moves.columns if c != key]).alias("row"))
    timed = moves.select(key, F.date_trunc(SLICES[0], F.col(order[0])).alias("_slice"), F.col(status).alias("_here"), row.alias("_e"))
    here, at, event = F.col("_here"), F.col("_e.at"), F.col("_e")
    opened = F.max(F.when(here == "OPEN", at)).over(Window.partitionBy(key, "_slice"))
    # a milestone without a time is none
    dated = here.isin("COMPLETED", "VERIFIED") & at[order[0]].isNotNull()
    reached = dated & (F.col("_opened").isNull() | (at > F.col("_opened")))

    def last(condition: Column) -> Column:
        return F.max_by(event, F.when(condition, at))

    def filled(c: str) -> Column:
        return F.nullif(F.col(f"_e.row.{c}"), F.lit("")).isNotNull()

    summary = timed.withColumn("_opened", opened).groupBy(key, "_slice").agg(
        F.struct(
            F.max_by(event, at).alias("last"),
            last(here == "OPEN").alias("opened"),
            F.min_by(event, F.when(reached, at)).alias("first"),
            last(reached & (here == "VERIFIED")).alias("verified"),
            *[last(filled(c)).alias(c) for c in ("notes", "officer_name", "officer_id")],
        ).alias("_sum")
    )
    return summary


def _merged(earlier: Column, later: Column) -> Column:
    """Summary of two stretches of an id's events, the second after the first. Associative."""
    reopened = later["opened"].isNotNull()

    def newest(field: str) -> Column:
        return F.coalesce(later[field], earlier[field])

    return F.struct(
        later["last"].alias("last"),
        newest("opened").alias("opened"),
        F.when(reopened, later["first"]).otherwise(F.coalesce(earlier["first"], later["first"])).alias("first"),
        F.when(reopened, later["verified"]).otherwise(newest("verified")).alias("verified"),
        *[newest(c).alias(c) for c in ("notes", "officer_name", "officer_id")],
    )


def action_summaries(events: DataFrame, key: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """``(key, _sum)`` per id: summaries of slices merged in time order, by the wider slice and then by id.

    The events are read once. A merge holds the summaries of one id and slice: at most the hours of a month, then the
    months of the log. Events without a time come first.
    """
    parts = _slice_summaries(events, key, status, order)
    for width in (*SLICES[1:], None):
        keys = [F.col(key)] + ([F.date_trunc(width, "_slice").alias("_wide")] if width else [])
        listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "_sum"))).alias("_l"))
        sums = F.transform("_l", lambda x: x["_sum"])
        rest = F.slice(sums, F.lit(2), F.size("_l"))
        parts = listed.withColumn("_sum", F.aggregate(rest, F.get(sums, F.lit(0)), _merged)).drop("_l")
        parts = parts.withColumnRenamed("_wide", "_slice")
    return parts


def compact_action_events(
    events: DataFrame, key: str = "action_id", status: str = "status", order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """At most seven events per action that give the same state as all of them.

    They also give it together with all events that come later in time. An OPEN that is delivered after later completions
    of its id finds only the kept ones of these.
    """
    sums = action_summaries(events, key, status, order)
    names = ("last", "opened", "first", "verified", "notes", "officer_name", "officer_id")
    rows = F.array_distinct(F.array_compact(F.array(*[F.col(f"_sum.{n}.row") for n in names])))
    return sums.select(key, F.inline(rows))


def action_state(
    events: DataFrame, key: str = "action_id", status: str = "status", order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """Current state per action. Reopening clears the milestones, so they count from the last OPEN on."""
    time = order[0]

    def kept(field: str, column: str) -> Column:
        return F.col(f"_sum.{field}.row.{column}")

    now = kept("last", status)
    verification = (
        F.when(now == "COMPLETED", "PENDING_VERIFICATION").when(now == "VERIFIED", "VERIFIED").otherwise("UNVERIFIED")
    )
    return action_summaries(events, key, status, order).select(
        key,
        now.alias("status"),
        verification.alias("verification_status"),
        kept("last", time).alias("updated_at"),
        kept("first", time).alias("completed_at"),
        kept("verified", time).alias("verified_at"),
        strip(kept("notes", "notes")).alias("tracking_notes"),
        strip(kept("officer_name", "officer_name")).alias("verified_by_officer"),
        strip(kept("officer_id", "officer_id")).alias("officer_id"),
    )


def action_statistics(state: DataFrame, status: str = "status", priority: str | None = "priority") -> DataFrame:
    """One row: zero-filled counts by status and priority, and the share completed or verified."""
    counts = [F.count("*").alias("total_actions")]
    counts += [F.count_if(F.col(status) == s).alias(f"{s.lower()}_count") for s in ACTION_STATUSES]
    if priority:
        counts += [F.count_if(F.col(priority) == p).alias(f"priority_{p.lower()}") for p in PRIORITIES]
    done = F.col("completed_count") + F.col("verified_count")
    return state.agg(*counts).withColumn("resolution_rate", percent(done, F.col("total_actions")))
