"""The detection chain on a stream, and live reports on its logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config, DEFAULT
from ..operators import dashboard as dash, gates, response, verdict
from ..operators.features import SESSION, flow_features, flow_named, packet_ids, rate_features, session_features, slice_size
from ..operators.history import join_tails, tails
from ..operators.numbering import renamed, same_keys
from ..plans.detect import scored_rows, usable_scorer
from ..runtime import step_tables, write_table
from ..sources.logstore import STORED, append_once
from .carry import CarryTable
from .flow_state import FLOW, FLOW_STATE, batch_state, flow_history

SESSION_TAIL = "sensor_id string, session_id string, tail array<struct<seq:bigint,ts_us:bigint,length:int>>"
VOTE_TAIL = "sensor_id string, session_id string, flow_id string, tail array<struct<seq:bigint,_mal:int>>"
VOTE = "_vote"
RESPONSE = "sensor_id string, ip string, blocked boolean, open_warnings int"


@dataclass
class LiveDetection:
    """Micro-batch logic: batch operators plus carry tables, so a stream gives
    the logs of a batch. A batch that is run again writes the same state, and
    its logs only once.

    A session's packets must arrive in the order of ``seq`` from batch to
    batch. Those behind the last one seen, and second copies within a batch, go
    to the rejects folder before anything counts them.
    """

    spark: SparkSession
    logs: str              # folder of the log table
    state: str             # folder of the carry tables, shared by all executors
    cfg: Config = DEFAULT
    score_columns: dict | None = None
    scorer: object = None
    blocked: DataFrame | None = None    # addresses blocked from the start: sensor_id, ip
    commands: object = None             # batch_id -> manual changes, see replay_response
    idle_timeout: float | None = None   # seconds after which a silent flow is forgotten
    number: bool = False                # ids over all sessions, where seq starts anew in each
    buckets: int = 64                   # of each carry table: a batch reads those of its keys
    sessions: CarryTable = field(init=False)
    flows: CarryTable = field(init=False)
    votes: CarryTable = field(init=False)
    responses: CarryTable = field(init=False)
    ids: CarryTable = field(init=False)

    def __post_init__(self):
        def table(name: str, keys: list[str], schema: str, buckets: int = self.buckets) -> CarryTable:
            return CarryTable(self.spark, f"{self.state}/{name}", keys, schema, buckets)

        self.sessions = table("sessions", SESSION, SESSION_TAIL)
        self.flows = table("flows", FLOW, FLOW_STATE)
        self.votes = table("votes", gates.VOTER, VOTE_TAIL)
        self.responses = table("responses", ["sensor_id", "ip"], RESPONSE)
        self.ids = table("ids", ["name"], "name string, last bigint", 1)

    def on_time(self, rows: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The packets of a batch that come in order with the names of their
        flows, the others, and the tails before. The batch is stored as it comes;
        only if some are late or copies, which narrow columns tell, it is split."""
        names = rows.columns
        rows = write_table(flow_named(rows), "packets")
        before = self.sessions.before(batch_id, rows)
        last = before.select(*SESSION, F.element_at("tail", -1)["seq"].alias("_last"))
        keys = [*SESSION, "seq"]
        seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(last, SESSION, "left")
        odd = seen.filter((F.col("_rows") > 1) | F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False)))
        odd = write_table(renamed(odd.select(*keys, "_last"), keys), "odd")
        if not odd.head(1):
            return rows, rows.select(*names).filter(F.lit(False)), before
        copy = F.row_number().over(Window.partitionBy(*keys).orderBy("ts_us"))
        some = rows.join(odd, same_keys(keys)).withColumn("_copy", copy)
        late = F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False)) | (F.col("_copy") > 1)
        some = write_table(some.withColumn("_late", late).select(*rows.columns, "_late"), "split")
        rest = rows.join(odd, same_keys(keys), "left_anti")
        packets = write_table(rest.unionByName(some.filter("NOT _late").drop("_late")), "on_time")
        return packets, some.filter("_late").select(*names), before

    def numbered(self, packets: DataFrame, batch_id: int) -> DataFrame:
        """Ids after those of the batches before."""
        before = self.ids.before(batch_id, self.spark.createDataFrame([("packets",)], "name string"))
        last = before.first()
        packets = write_table(packet_ids(packets, last["last"] if last else 0), "numbered")
        now = packets.agg(F.lit("packets").alias("name"), F.max("id").alias("last")).filter("last IS NOT NULL")
        self.ids.save(batch_id, now, before)
        return packets

    def session_carry(self, rows: DataFrame, before: DataFrame, batch_id: int, size: int | None = None) -> DataFrame:
        """Session features of a batch, given the tails before it."""
        n, named = self.cfg.rolling_window, rows.select(*SESSION).distinct()
        now = tails(rows, SESSION, "seq", ["ts_us", "length"], n)
        self.sessions.save(batch_id, join_tails(before, now, SESSION, n), before, named=named)
        known = None if self.sessions.fresh(batch_id) else before.join(named, SESSION, "left_semi")
        return session_features(rows, self.cfg, size, known)

    def flow_carry(self, packets: DataFrame, rows: DataFrame, batch_id: int, size: int | None = None) -> DataFrame:
        """Flow features of a batch, given the flows before it. Flows that have
        been silent twice as long as ``idle_timeout`` leave the table."""
        before = self.flows.before(batch_id, packets)
        known, after = batch_state(packets, before, self.cfg, self.idle_timeout)
        keep = None
        if self.idle_timeout is not None:
            newest = packets.agg(F.max("ts_us")).first()[0]
            keep = None if newest is None else F.col("last_us") >= newest - int(2 * self.idle_timeout * 1_000_000)
        self.flows.save(batch_id, after, before, keep, packets.select(*FLOW).distinct())
        return flow_features(rows, self.cfg, size, None if self.flows.fresh(batch_id) else flow_history(known))

    def vote_carry(self, packets: DataFrame, rows: DataFrame, batch_id: int, size: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Vote shares of a batch, given the votes before it, and these."""
        before, touched = self.votes.before(batch_id, packets), None
        if not self.votes.fresh(batch_id):
            touched = before.join(packets.select(*gates.VOTER).distinct(), gates.VOTER, "left_semi")
        return gates.consensus(rows.withColumn(VOTE, gates.vote(self.cfg)), self.cfg, size, touched), before

    def save_votes(self, decided: DataFrame, before: DataFrame, batch_id: int) -> None:
        now = gates.vote_tails(decided, VOTE, self.cfg)
        self.votes.save(batch_id, join_tails(before, now, gates.VOTER, self.cfg.vote_window), before)

    def response_batch(self, rows: DataFrame, batch_id: int) -> response.Replay:
        """Replay a batch on top of the blocks and warnings before it."""
        commands = self.commands(batch_id) if self.commands else None
        named = rows.select("sensor_id", F.col("source_ip").alias("ip")).union(rows.select("sensor_id", "destination_ip"))
        if commands is not None:
            named = named.union(commands.select("sensor_id", "ip"))
        first = self.blocked.select("sensor_id", "ip").distinct() if batch_id == 0 and self.blocked is not None else None
        before = self.responses.before(batch_id, named if first is None else named.union(first))
        if first is not None:
            before = first.withColumns({"blocked": F.lit(True), "open_warnings": F.lit(0)})
        replay = response.replay_response(
            rows, before.filter("blocked").select("sensor_id", "ip"),
            before.filter("open_warnings > 0").select("sensor_id", "ip", F.col("open_warnings").alias("count")),
            commands, ("sensor_id",), "seq", self.cfg)
        after = replay.state.select("sensor_id", "ip", "blocked", "open_warnings")
        self.responses.save(batch_id, after, before)
        return replay

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with step_tables():
            self.process(batch, batch_id)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        cfg = self.cfg
        packets, late, before = self.on_time(batch, batch_id)
        late.write.mode("overwrite").parquet(f"{self.state}/rejects/b={batch_id}")
        packets = self.numbered(packets, batch_id) if self.number else packets
        size = slice_size(packets, cfg, "auto")
        rows = self.flow_carry(packets, self.session_carry(packets, before, batch_id, size), batch_id, size)
        rows = rate_features(rows)
        scorer = usable_scorer(rows.columns, self.scorer)
        if self.score_columns is None and scorer is None:
            decided = verdict.log_inputs(verdict.classify(gates.metadata_rules(rows, cfg), cfg))
            decided = write_table(response.marked(decided, cfg), "decided")
        else:
            rows = scored_rows(rows, cfg, self.score_columns, scorer)
            if size is not None:
                rows = write_table(rows, "scored")  # the sliced vote window reads it more than once
            voted, before = self.vote_carry(packets, rows, batch_id, size)
            decided = verdict.log_inputs(verdict.classify(gates.decide(voted, cfg), cfg), VOTE)
            decided = write_table(response.marked(decided, cfg), "decided")
            self.save_votes(decided, before, batch_id)
            decided = decided.drop(VOTE)
        replay = self.response_batch(decided, batch_id)
        replay.rejects.write.mode("overwrite").parquet(f"{self.state}/bad-sources/b={batch_id}")
        append_once(verdict.build_logs(replay.rows, log_id="id" if self.number else "seq"), self.logs, batch_id)


def start_detection(packets: DataFrame, detection: LiveDetection, checkpoint: str,
                    available_now: bool = False) -> StreamingQuery:
    """Run the chain on a stream of packets until it is stopped, or once over
    what is there."""
    writer = packets.writeStream.foreachBatch(detection)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(query: StreamingQuery) -> None:
    """Wait until a query over what is there has ended; its failure is raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log table as a stream."""
    return spark.readStream.schema(STORED).parquet(path)


def live_summary(logs: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Counts per time window, for update mode."""
    return logs.groupBy(F.window("timestamp", width).alias("window")).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(dash.is_threat()).alias("alerts"),
        F.count_if("encrypted_likely").alias("encrypted"),
        F.count_if(F.col("action") == "blocked").alias("blocked"),
    )


def notify_once(logs: DataFrame) -> DataFrame:
    """The first log row of each alert identity in the stream."""
    return dash.alerts(logs).dropDuplicates(["alert_key"])
