"""The tables the operators take, projected from the TPC-H-like test tables.

They follow ``FIXTURES.md`` with these differences: a device is offline in an hour with an
error of at least 200, sessions are one user's day, accounts hold several devices, node types come from the
account balance, models and problem kinds go round by key, and hardware addresses carry a
colon to be removed.
``sql_views`` holds the same projections in SQL.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import FAILURE_KINDS
from fleetpulse.plans.devices import device_vector
from fleetpulse.plans.failures import failing_devices, failing_sessions
from fleetpulse.plans.interface import downstream_vector, upstream_vector
from fleetpulse.plans.vectors import five_day_history, numbered, one_day_vector
from fleetpulse.operators.windows import day_differences, day_means
from fleetpulse.session import staged

DAY = date(2024, 1, 15)
ORDER_DAY = date(1998, 6, 15)

# models of the devices in turn: the supported ones and one with deep sleep
MODELS = [*S.MODEL_IDS, "SLEEPING BOX"]
# problem kinds in turn: those that count as a failure and one that doesn't
KINDS = [*FAILURE_KINDS, "internet.speedtest.start"]


def text(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def when_type(kind: str) -> Column:
    return F.avg(F.when(F.col("event_type") == kind, F.col("value")))


class Inputs:
    """Lazy projections of the tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    # ---- telemetry -------------------------------------------------------------------------

    @cached_property
    def health_hour(self) -> DataFrame:
        e = self.events
        failed = F.max(F.when((F.col("event_type") == "error") & (F.col("value") >= 200), 1).otherwise(0))
        return (
            e.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_stamp"))
            .agg(
                F.when(failed == 1, 4).otherwise(8).alias("cm_status"),
                when_type("signup").alias("cer_dn"), when_type("error").alias("cer_up"),
                F.min("value").alias("pct_traffic_dmh_up"),
                F.avg(F.when(F.col("event_type").isin("click", "view"), F.col("value"))).alias("pct_traffic_sdmh_up"),
                F.avg("value").alias("rxpower_dn"), when_type("view").alias("rxpower_up"),
                when_type("purchase").alias("snr_dn"), F.max("value").alias("snr_up"),
                when_type("click").alias("txpower_up"),
            )
            .select(
                F.concat(F.lit("AA"), F.lpad(text("user_id"), 8, "0")).alias("mac"),
                text(F.col("user_id") % 97).alias("account_number"), "hour_stamp", "cm_status", *S.DEVICE_MEASURES,
            )
        )

    def _interface_hours(self, name: Column, column: str, **measures: Column) -> DataFrame:
        return (
            self.events.groupBy(
                F.concat(F.lit("H"), text(F.col("user_id") % 2)).alias("cmts_name"), name.alias(column),
                F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
            ).agg(*[c.alias(m) for m, c in measures.items()])
        )

    @cached_property
    def ifc_down_hour(self) -> DataFrame:
        i = text(F.col("user_id") % 10)
        return self._interface_hours(
            F.concat(F.lit("x Downstream "), i, F.lit("/"), i, F.lit(" y")), "downstream_name",
            rxpower=F.avg("value"), avg_snr=when_type("click"), ccer=when_type("error"), cer=when_type("signup"),
            utilization=F.count("*").cast("double"),
        )

    @cached_property
    def ifc_up_hour(self) -> DataFrame:
        i = text(F.col("user_id") % 10)
        return self._interface_hours(
            F.concat(F.lit("cable-Upstream "), i, F.lit("/1/0")), "upstream_name",
            rxpower=when_type("view"), txpower=when_type("click"), cer=when_type("error"),
            utilization=F.count("*").cast("double"), ms_utilization=when_type("purchase"),
            freecont_ms_utilization=F.max("value"),
        )

    @cached_property
    def ifc_to_group(self) -> DataFrame:
        i = text(F.col("user_id") % 10)
        ends = F.explode(F.array(
            F.concat(F.lit("Downstream "), i, F.lit("/"), i), F.concat(F.lit("Upstream "), i, F.lit("/1/0"))
        ))
        return self.events.select(
            F.concat(F.lit("H"), text(F.col("user_id") % 2)).alias("cmts_name"),
            F.concat(F.lit("G"), text(F.col("user_id") % 5)).alias("service_group_name"), ends.alias("ifc_descr"),
        ).distinct()

    @cached_property
    def topo_nodes(self) -> DataFrame:
        model = F.array(*[F.lit(m) for m in MODELS])[(F.col("c_custkey") % len(MODELS)).cast("int")]
        return self.table("customer").select(
            F.concat(F.lit("aa:"), F.lpad(text("c_custkey"), 8, "0")).alias("node_key"),
            model.alias("src_node_model"), text("c_nationkey").alias("src_node_building_id"),
            text(F.col("c_custkey") % 97).alias("cly_acct_number"),
            F.when(F.col("c_acctbal") < 0, 1).otherwise(55).alias("topo_node_type_id"),
        )

    @cached_property
    def group_history(self) -> DataFrame:
        return self.events.where(F.col("event_type").isin("click", "view")).select(
            F.concat(F.lit("H"), text(F.col("user_id") % 2)).alias("cmts"),
            F.concat(F.lit("G"), text(F.col("user_id") % 5)).alias("service_group"),
            F.concat(F.lit("aa:"), F.lpad(text("user_id"), 8, "0")).alias("mac"),
            F.col("ts").alias("modemloss_valid_from"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("modemloss_valid_to"),
        )

    @cached_property
    def order_history(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.lit("H"), text(F.col("o_custkey") % 2)).alias("cmts"),
            F.concat(F.lit("G"), text(F.col("o_custkey") % 5)).alias("service_group"),
            F.concat(F.lit("aa:"), F.lpad(text("o_custkey"), 8, "0")).alias("mac"),
            F.col("o_orderdate").alias("modemloss_valid_from"),
            (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("modemloss_valid_to"),
        )

    # ---- support logs ----------------------------------------------------------------------

    @cached_property
    def milestones(self) -> DataFrame:
        return self.events.select(
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"), (F.col("event_id") % 4).alias("flow_id"),
            F.col("event_id").alias("event_no"), F.concat(F.lit("internet."), "event_type", F.lit(".start")).alias("milestone_name"),
            F.when(F.col("event_id") % 3 == 0, "tv").otherwise("Internet").alias("process_flow"),
            F.col("ts").alias("start_time"), F.col("ts").alias("calendar_date"),
            F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("cnt_interact_sent"), F.lit(0).alias("cnt_case_sent"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return self.events.where("event_type = 'error'").select(
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("journal_id"),
            (F.col("event_id") % 3).alias("emp_id"), F.col("event_id").alias("case_id"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        return self.events.where("event_type = 'error'").select(
            F.col("event_id").alias("id"), text(F.col("user_id") % 97).alias("customer_id"),
            F.lit("first").alias("cust_first_name"), F.lit("last").alias("cust_last_name"),
            F.col("value").alias("duration"), F.col("ts").alias("start_time"),
        )

    @cached_property
    def interactions(self) -> DataFrame:
        return self.events.where(F.col("event_type").isin("click", "view")).select(
            F.col("event_id").alias("interaction_id"), text(F.col("user_id") % 97).alias("account_number"),
            F.col("ts").alias("create_date"), (F.col("event_id") % 3).alias("emp_id"),
            F.when(F.col("event_id") % 4 == 0, 1).otherwise(0).alias("flg_ftr_0d_flg"),
            (F.col("event_id") % 2).cast("int").alias("flg_ftr_7d_flg"),
        )

    @cached_property
    def run_log(self) -> DataFrame:
        failed = F.count_if(F.col("event_type") == "error")
        return self.events.groupBy(F.to_date("ts").alias("d")).agg(
            F.max("ts").cast("timestamp").alias("log_date"),
            (failed * 5 > F.count("*")).cast("int").alias("is_error"),
            F.concat(text(F.count("*")), F.lit(" rows inserted in events")).alias("log_text"),
            F.lit(1).alias("is_done"),
        ).drop("d")

    # ---- derived by the composites ---------------------------------------------------------

    @cached_property
    def vector_1d(self) -> DataFrame:
        return one_day_vector(
            device_vector(self.health_hour, self.topo_nodes, self.group_history),
            upstream_vector(self.ifc_up_hour, self.ifc_to_group),
            downstream_vector(self.ifc_down_hour, self.ifc_to_group),
        )

    @cached_property
    def daily_avg(self) -> DataFrame:
        return day_means(self.vector_1d)

    @cached_property
    def daily_diffs(self) -> DataFrame:
        return day_differences(self.daily_avg)

    @cached_property
    def five_day(self) -> DataFrame:
        # written first: numbering reads the rows more than once
        return numbered(staged(five_day_history(self.vector_1d), "five-day"))

    @cached_property
    def via_sessions(self) -> DataFrame:
        return failing_sessions(self.milestones, self.sessions, self.cases, self.interactions)

    @cached_property
    def via_macs(self) -> DataFrame:
        return failing_devices(self.milestones, self.sessions, self.cases, self.interactions, self.topo_nodes)

    # ---- modelling -------------------------------------------------------------------------

    @cached_property
    def device_day(self) -> DataFrame:
        """Device-day rows with plain daily means and a label: an error on the next day."""
        h = self.health_hour.withColumn("day_0", F.to_date("hour_stamp"))
        daily = h.groupBy("mac", "day_0").agg(
            *[F.avg(m).alias(name) for m, name in S.DEVICE_MEASURES.items()],
            (100.0 * F.avg(F.when(F.col("cm_status") != 8, 1.0).otherwise(0.0))).alias("offline_pct"),
        )
        failing = h.where("cer_up IS NOT NULL").select("mac", F.date_sub("day_0", 1).alias("day_0")).distinct()
        turn = (F.substring("mac", 3, 8).cast("long") + F.dayofmonth("day_0")) % len(KINDS)
        kind = F.array(*[F.lit(k) for k in KINDS])[turn.cast("int")]
        models = self.topo_nodes.select(
            F.upper(F.replace("node_key", F.lit(":"), F.lit(""))).alias("mac"), F.col("src_node_model").alias("hardware_model")
        )
        return (
            daily.join(failing.withColumn("milestone_name", kind), ["mac", "day_0"], "left")
            .join(models, "mac")
            .withColumn("seq_id", F.substring("mac", 3, 8).cast("long") * 100 + F.dayofmonth("day_0"))
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), F.to_date("ts").alias("day_0"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
            F.least(F.lit(1.0), F.floor(F.col("value") * 2).cast("double") / 1000.0).alias("score"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "X").otherwise("Y").alias("grp"),
            F.transform("embedding", lambda x: x.cast("double")).alias("v"),
        )

    @cached_property
    def clustered(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("cluster"),
            F.when(F.col("label") <= 2, 1).otherwise(0).alias("label"),
            F.transform("embedding", lambda x: x.cast("double")).alias("v"),
        )

    @cached_property
    def wide(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty_copy"),
            (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("twice"),
            F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7), 1.0).otherwise(0.0).alias("rare"),
            F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("disc_known"),
            F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax_known"),
            F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("ship_day"),
            F.when(F.weekday("l_shipdate") >= 5, 1).otherwise(0).alias("weekend"),
        )
