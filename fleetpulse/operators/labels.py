"""Failure labels from support sessions: starting milestones, as-of matching, expansion."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import on_day
from fleetpulse.operators.groups import node_details

FLOW = "INTERNET"
ACCOUNT_PARTS = 16  # tasks that share the devices of one account
DEVICE_PARTS = 4  # tasks that pack the devices of one account
PACKED_ROWS = 504  # rows of a packed block at most: 63 groups of 8, a whole bit-packed run of a Parquet page, so that blocks repeat byte by byte


def flow_milestones(milestones: DataFrame, flow: str = FLOW, day: date | None = None) -> DataFrame:
    """Milestones of one process flow (any letter case), optionally of one day; adds ``m_day``."""
    picked = milestones if day is None else milestones.where(on_day("calendar_date", day))
    return picked.where(F.upper("process_flow") == flow).withColumn("m_day", F.to_date("calendar_date"))


def finished_flows(milestones: DataFrame) -> DataFrame:
    """Distinct (m_day, session, flow) that sent an interaction or a case."""
    done = milestones.where((F.col("cnt_interact_sent") > 0) | (F.col("cnt_case_sent") > 0))
    return done.select("m_day", "session_id", "flow_id").distinct().withColumn("tag", F.lit("FULL"))


def tag_finished(milestones: DataFrame, finished: DataFrame) -> DataFrame:
    """Full outer join that puts ``tag`` in front of the rows of finished flows."""
    keys = ["m_day", "session_id", "flow_id"]
    joined = milestones.join(finished, keys, "full_outer")
    return joined.select("tag", *milestones.columns)


def first_events(tagged: DataFrame) -> DataFrame:
    """First event number of the finished flows of each session and day."""
    return (
        tagged.where("tag = 'FULL'")
        .groupBy("m_day", "session_id")
        .agg(F.min("event_no").alias("event_no_milestone"))
        .withColumn("starting_milestone", F.lit(1))
    )


def tag_starting(milestones: DataFrame, firsts: DataFrame) -> DataFrame:
    """Full outer join that marks each session's starting event."""
    renamed = firsts.select("m_day", "session_id", F.col("event_no_milestone").alias("event_no"), "starting_milestone")
    joined = milestones.join(renamed, ["m_day", "session_id", "event_no"], "full_outer")
    return joined.select("starting_milestone", *milestones.columns)


def starting_milestones(milestones: DataFrame) -> DataFrame:
    """Starting milestone of each session and day, without any join.

    Three aggregates with map-side combine replace the tag / flag / tag-again joins: which
    flows finished, the first event of each flow, and the first among finished flows.
    """
    done = (F.col("cnt_interact_sent") > 0) | (F.col("cnt_case_sent") > 0)
    first = F.min(F.struct("event_no", "milestone_name", "process_flow", "start_time"))
    flows = (
        milestones.groupBy("m_day", "session_id", "flow_id")
        .agg(F.max(F.coalesce(done, F.lit(False))).alias("finished"), first.alias("f"))
        .where("finished")
    )
    return (
        flows.groupBy("m_day", "session_id").agg(F.min("f").alias("f"))
        .select(
            "m_day", "session_id", F.col("f.event_no").alias("event_no"),
            F.col("f.milestone_name").alias("milestone_name"), F.col("f.process_flow").alias("process_flow"),
            F.col("f.start_time").alias("milestone_start_t"),
        )
    )


def session_details(starts: DataFrame, sessions: DataFrame, cases: DataFrame) -> DataFrame:
    """Starting milestones with employee, case and customer; ``day_0`` is the day before."""
    s = sessions.select(F.col("journal_id").alias("session_id"), "emp_id", "case_id")
    c = cases.select(
        F.col("id").alias("case_id"), F.col("customer_id").alias("cly_account_number"),
        F.col("start_time").alias("case_start_t"),
    )
    return (
        starts.join(s, "session_id").join(c, "case_id")
        .select(
            "case_id", "emp_id", "case_start_t", "session_id", "process_flow", "milestone_name",
            "cly_account_number", F.date_sub("m_day", 1).alias("day_0"),
        )
    )


def first_after(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    slot_seconds: int = 300,
) -> DataFrame:
    """As-of join: each left row with the earliest right row of its key not before it.

    Left rows without such a row, or with a NULL key or time, drop out. Ties in time go to
    the smaller payload. No pair list is built. Time is cut into slots: inside a slot a
    running minimum over the merged rows finds the match, and when the slot has none the
    first right row of the next used slot is it. So a hot key is spread over its slots, and
    the per-key step sees one aggregated row per slot.
    """
    def slot(ts: str):
        # from the wall-clock parts, so that it rises with ts in any session time zone
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
        second = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        return F.floor(second / slot_seconds)

    left = left.dropna(subset=[*keys, left_time])
    right = right.dropna(subset=[*keys, right_time])
    item = F.struct(F.col(right_time).alias("_t"), *payload)
    empty = F.lit(None)

    r = right.select(*keys, slot(right_time).alias("_slot"), F.col(right_time).alias("_at"), item.alias("_r"))
    slots_r = r.groupBy(*keys, "_slot").agg(F.min("_r").alias("_first"))
    slots_l = left.select(*keys, slot(left_time).alias("_slot")).distinct()
    ahead = W.partitionBy(*keys).orderBy(F.col("_slot").desc()).rowsBetween(W.unboundedPreceding, -1)
    following = (
        slots_l.join(slots_r, [*keys, "_slot"], "full_outer")
        .withColumn("_next", F.last("_first", ignorenulls=True).over(ahead))
        .select(*keys, "_slot", "_next")
    )
    merged = (
        left.select(*keys, slot(left_time).alias("_slot"), F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_l"))
        .withColumn("_r", empty.cast(r.schema["_r"].dataType))
        .unionByName(r.withColumn("_l", empty.cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType)))
    )
    # latest first; at equal times the right rows come before the left row that may use them
    order = [F.col("_at").desc(), F.col("_r").isNull(), F.col("_r").desc()]
    back = W.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    matched = merged.withColumn("_hit", F.last("_r", ignorenulls=True).over(back)).where(F.col("_l").isNotNull())
    found = matched.join(following, [*keys, "_slot"]).withColumn("_m", F.coalesce("_hit", "_next"))
    return found.where(F.col("_m").isNotNull()).select(
        "_l.*", F.col("_m._t").alias(right_time), *[F.col(f"_m.{p}").alias(p) for p in payload]
    )


def match_interactions(details: DataFrame, interactions: DataFrame) -> DataFrame:
    """Each session case with the first interaction of the same day, account and employee.

    The case must have started on the day after ``day_0``, the day whose interactions count.
    """
    d = details.withColumn("_day", F.to_date("case_start_t")).where(F.col("_day") == F.date_add("day_0", 1))
    i = interactions.select(
        "interaction_id", F.col("account_number").alias("cly_account_number"), "create_date",
        "emp_id", "flg_ftr_0d_flg", "flg_ftr_7d_flg", F.to_date("create_date").alias("_day"),
    )
    return first_after(
        d, i, ["_day", "cly_account_number", "emp_id"], "case_start_t", "create_date",
        ["interaction_id", "flg_ftr_0d_flg", "flg_ftr_7d_flg"],
    ).drop("_day")


def session_success(matches: DataFrame) -> DataFrame:
    """Resolution flags of the earliest interaction matched to each session and label day."""
    first = F.min(F.struct("create_date", "interaction_id", "flg_ftr_0d_flg", "flg_ftr_7d_flg"))
    return matches.groupBy("day_0", "session_id").agg(first.alias("f")).select(
        "day_0", "session_id", F.col("f.flg_ftr_0d_flg").alias("flg_ftr_0d_flg"),
        F.col("f.flg_ftr_7d_flg").alias("flg_ftr_7d_flg"),
    )


def _packed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """(keys, ``name``): the rows of each key in arrays of at most ``PACKED_ROWS`` structs, sorted."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    item = F.struct(*[c for c in rows.columns if c not in keys])
    blocks = rows.withColumn("_block", F.floor(number / PACKED_ROWS)).groupBy(*keys, "_block")
    return blocks.agg(F.array_sort(F.collect_list(item)).alias(name)).drop("_block")


def devices_of_accounts(details: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each session detail once per device of its account, with any further columns of ``details`` last.

    The result is much larger than both inputs, so the join is cut by account and by a hash of the detail into
    a fixed number of tasks, which adaptive execution would merge by the size of the inputs; a busy account is
    ``ACCOUNT_PARTS`` of them, and a device travels that often. Blocks of details meet blocks of devices and are
    spread out last, so a detail comes with the same devices in the same order as the one before it: written in
    columns, such rows are runs and repeats and take a small part of the space of rows in any other order.
    """
    account = "cly_account_number"
    listed = ["case_id", "session_id", "emp_id", account, "mac", "case_start_t", "process_flow", "milestone_name", "day_0"]
    keys = [account, "_part"]
    tasks = int(details.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("case_id", "session_id"), F.lit(ACCOUNT_PARTS)).cast("int")
    left = details.dropna(subset=[account]).withColumn("_part", own).repartition(tasks, *keys)
    left = _packed(left, keys, ["case_id", "session_id"], "_details")
    macs = node_details(nodes).select("mac", account).dropna(subset=[account])
    macs = macs.withColumn("_of", F.pmod(F.xxhash64("mac"), F.lit(DEVICE_PARTS)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(ACCOUNT_PARTS - 1)))
    right = _packed(macs, [account, "_of"], ["mac"], "_macs").select(account, "_macs", parts.alias("_part"))
    pairs = left.join(right.repartition(tasks, *keys), keys)
    each = pairs.select(account, "_macs", F.inline("_details"))
    return each.select(*details.columns, F.inline("_macs")).select(*listed, *[c for c in details.columns if c not in listed])


def confirmed_devices(devices: DataFrame, success: DataFrame) -> DataFrame:
    """Devices, or session details, with their session's resolution flags.

    Details are best confirmed before ``devices_of_accounts`` multiplies them: the rows are the same.
    """
    return devices.join(success, ["day_0", "session_id"]).select(
        *devices.columns, "flg_ftr_7d_flg", "flg_ftr_0d_flg"
    )


def device_labels(details: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mac, day_0, milestone_name, n): how many rows of ``devices_of_accounts`` say so.

    Details are counted per account, day and name first, so the table grows with the devices and not with
    devices times sessions.
    """
    counts = details.groupBy("cly_account_number", "day_0", "milestone_name").agg(F.count("*").alias("_c"))
    macs = node_details(nodes).groupBy("mac", "cly_account_number").agg(F.count("*").alias("_d"))
    return counts.join(macs, "cly_account_number").groupBy("mac", "day_0", "milestone_name").agg(F.sum(F.col("_c") * F.col("_d")).alias("n"))
