"""Blocklist feedback: who is blocked from which packet on, and the actions.

A block changes the fate of later packets of other flows, so it cannot be kept
as per-key state. It is solved as a fixpoint over small tables instead. A packet
may trigger a block only if its destination is not blocked at that time, and
who is blocked at one packet depends on earlier packets only, so iterating
"blocks -> valid triggers -> blocks" ends at the one exact answer.

All state is rows. Manual commands cut the life of an address into epochs, and
within one it is blocked at most once, so "is it blocked at this packet" is an
equi-join on address and epoch and one comparison. A packet's epoch is an as-of
lookup: packets and commands in one order, a running count of the commands.

Only pairs are iterated: while an address stays blocked, the valid triggers of
one (source, destination) pair are the earliest ones, so the first immediate
and the first few reconnaissance packets of a pair stand for all of them. That
reduction is a map-side top-n, whatever share of the packets one source sends.
Rounds are semi-naive: after the first, only sources with a trigger whose
validity has changed are worked out again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import Config, DEFAULT, NOTE_BLOCKLISTED, NOTE_MANUAL_BLOCK, NOTE_UNCERTAIN
from ..functions import labels as lab, network as net
from ..functions.columns import filled, is_true
from ..runtime import write_table
from ..schemas import BLOCK_CHANGES
from .numbering import numbered, running_total

# What a round finds out: "from" (blocked in this epoch after packet ``at``), "step"
# (the packet ``at`` is reconnaissance warning ``step``), "end" (warnings open at the
# end, or BLOCKED).
FACTS = "ip string, what string, epoch bigint, at bigint, step int"
REJECTED = "_rejected"
BLOCKED = -1


# --- block log --------------------------------------------------------------

def _change(spark, ip, op: str, reason: str | None, at) -> DataFrame:
    row = spark.createDataFrame([(ip, op, reason, at)], BLOCK_CHANGES)
    canonical = net.normalise_ip("ip")
    return row.withColumn("ip", F.coalesce(canonical, F.raise_error(F.concat(F.lit("Invalid IP address: "), "ip"))))


def block(spark, ip: str, reason: str = NOTE_MANUAL_BLOCK, at=None) -> DataFrame:
    """A block command as one row of the change log."""
    if len(reason) > 300:
        raise ValueError("a block reason has at most 300 characters")
    return _change(spark, ip, "block", reason, at)


def unblock(spark, ip: str, at=None) -> DataFrame:
    return _change(spark, ip, "unblock", None, at)


def change_log(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many commands (ip, op, reason, at) as rows of the change log, and those
    refused: no address, another op, or a block reason above 300 characters."""
    ip = net.normalise_ip("ip")
    op = F.col("op").isin("block", "unblock")
    fits = F.length(F.coalesce("reason", F.lit(""))) <= 300
    ok = is_true(ip.isNotNull() & op & ((F.col("op") == "unblock") | fits))
    blocks = F.col("op") == "block"
    reason = F.when(blocks, F.coalesce("reason", F.lit(NOTE_MANUAL_BLOCK)))
    return commands.filter(ok).select(ip.alias("ip"), "op", reason.alias("reason"), "at"), commands.filter(~ok)


def blocklist(changes: DataFrame) -> DataFrame:
    """Current entries of a change log: the latest change per address, newest first."""
    newest = Window.partitionBy("ip").orderBy(F.desc("at"), F.desc("op"))
    last = changes.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1)
    return (
        last.filter(F.col("op") == "block")
        .select("ip", "reason", F.col("at").alias("created_at"))
        .orderBy(F.desc("created_at"), "ip")
    )


def flag_blocked(rows: DataFrame, blocked: DataFrame, flag: str = "blocked_before") -> DataFrame:
    """Whether source or destination is on a list of addresses. Joined on
    ``ip`` and on any further columns both sides share by name, twice; the
    planner broadcasts the list while its size allows."""
    on = [c for c in blocked.columns if c != "ip" and c in rows.columns]
    marks = blocked.select(*on, "ip").distinct()
    for side in ("source_ip", "destination_ip"):
        mark = marks.withColumnRenamed("ip", side).withColumn(f"_hit_{side}", F.lit(True))
        rows = rows.join(mark, [*on, side], "left")
    hit = is_true(F.col("_hit_source_ip")) | is_true(F.col("_hit_destination_ip"))
    return rows.withColumn(flag, hit).drop("_hit_source_ip", "_hit_destination_ip")


# --- actions ----------------------------------------------------------------

def trigger(cfg: Config = DEFAULT) -> Column:
    """What a decided packet would set off: ``block``, ``recon`` or null."""
    label = lab.attack_or_prediction()
    quiet = (
        (F.col("reason") == "model_uncertain_attack") | lab.is_benign("prediction")
        | (F.col("severity") == "info") | filled("source_ip").isNull()
    )
    return F.when(quiet, None).when(lab.blocks_at_once(label), "block").when(lab.is_recon(label), "recon")


def is_address(col: Column | str) -> Column:
    """An IPv4 or IPv6 address. JVM only."""
    c = F.col(col) if isinstance(col, str) else col
    return net.is_ipv4(c) | net.is_ipv6(c)


def split_rejects(rows: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Packets whose source would be acted on but is no address cannot be
    blocked; they go to a rejects table instead of the log. Tables that are
    stored first may bring the answer along, see ``marked``."""
    if REJECTED not in rows.columns:
        rows = marked(rows, cfg)
    return rows.filter(~F.col(REJECTED)).drop(REJECTED), rows.filter(REJECTED).drop(REJECTED)


def marked(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add whether ``split_rejects`` takes a row out, to be looked up once only."""
    return rows.withColumn(REJECTED, is_true(trigger(cfg).isNotNull() & ~is_address("source_ip")))


def select_action(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``action`` and ``response_note``, from ``blocked_before`` and ``recon_step``.

    The kind and the case are columns first: expressions that repeat them make
    methods that are too large for the JIT.
    """
    last = F.col("recon_step") >= cfg.recon_limit
    quiet = lab.is_benign("prediction") | (F.col("severity") == "info")
    uncertain = F.col("reason") == "model_uncertain_attack"
    kind, case = F.col("_kind"), F.col("_case")
    cases = (
        F.when(F.col("blocked_before"), "listed").when(uncertain, "uncertain").when(quiet, "quiet")
        .when(kind == "block", "at_once").when((kind == "recon") & last, "recon_last").when(kind == "recon", "recon")
        .otherwise("alert")
    )
    rows = rows.withColumn("_kind", trigger(cfg)).withColumn("_case", cases)
    return rows.withColumns({
        "action": F.when(case.isin("listed", "at_once", "recon_last"), "blocked")
        .when(case.isin("uncertain", "recon"), "warning").when(case == "quiet", "allow").otherwise("alert"),
        "response_note": F.when(case == "listed", NOTE_BLOCKLISTED).when(case == "uncertain", NOTE_UNCERTAIN)
        .when(case == "at_once", F.concat(F.lit("Auto-blocked "), F.col("prediction"), F.lit(" traffic")))
        .when(case == "recon_last", f"Auto-blocked after {cfg.recon_limit} reconnaissance warnings")
        .when(case == "recon", F.concat(F.lit("Recon warning "), F.col("recon_step").cast("string"), F.lit(f"/{cfg.recon_limit}"))),
    }).drop("_kind", "_case")


def preview_action(rows: DataFrame, blocked: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Actions against a fixed list, without feedback: every reconnaissance
    packet counts as a first warning. For what-if reports on stored decisions."""
    rows = rows.withColumn("blocked_before", F.lit(False)) if blocked is None else flag_blocked(rows, blocked)
    return select_action(rows.withColumn("recon_step", F.lit(1)), cfg).drop("blocked_before", "recon_step")


# --- replay -----------------------------------------------------------------

@dataclass
class Replay:
    """Outcome of a replay. ``state`` has one row per address that was ever
    blocked, warned or commanded in it; ``facts`` what led to it."""

    rows: DataFrame      # the input rows with action and response_note
    state: DataFrame     # scope, ip, open_warnings, blocked, commanded
    facts: DataFrame     # scope and FACTS
    rejects: DataFrame
    rounds: int
    worked: list[int]    # sources worked out in each round but the first


def _epochs(rows: DataFrame, orders: DataFrame | None, keys: list[str], side: str, order: str, most: int) -> DataFrame:
    """Add ``epoch_<side>``: how many commands on the address have come up to the
    packet; -1 for an address without commands."""
    name = f"epoch_{side}"
    if orders is None:
        return rows.withColumn(name, F.lit(-1).cast("long"))
    marks = orders.select(*keys, F.col("ip").alias(side), (F.col("seq") * 2).alias("_at"), F.lit(1).cast("long").alias("_command"))
    named = marks.select(*keys, side).distinct()
    rest = rows.join(named, [*keys, side], "left_anti").withColumn(name, F.lit(-1).cast("long"))
    asked = rows.join(named, [*keys, side], "left_semi").withColumns(
        {"_at": F.col(order).cast("long") * 2 + 1, "_command": F.lit(0).cast("long")})
    both = running_total(asked.unionByName(marks, allowMissingColumns=True), [*keys, side], ["_at"], F.col("_command"), name, most)
    return both.filter("_command = 0").select(*rest.columns).unionByName(rest)


def _orders(commands: DataFrame, initial: DataFrame | None, warnings: DataFrame | None, keys: list[str], most: int) -> DataFrame:
    """One row for each address and packet with commands: epoch it begins, kind
    (block, unblock, or both: blocked, then released), and the start state."""
    has = lambda op: F.max(F.col("op") == op)
    kind = F.when(F.col("_b") & F.col("_u"), "both").when(F.col("_b"), "manual").otherwise("unblock")
    rows = commands.groupBy(*keys, "ip", F.col("at_seq").cast("long").alias("seq")).agg(has("block").alias("_b"), has("unblock").alias("_u"))
    rows = running_total(rows, [*keys, "ip"], ["seq"], F.lit(1).cast("long"), "epoch", most)
    rows = rows.select(*keys, "ip", "seq", "epoch", kind.alias("kind"))
    base = F.lit(0)
    if warnings is not None:
        rows = rows.join(warnings.select(*keys, "ip", F.col("count").cast("int").alias("_count")), [*keys, "ip"], "left")
        base = F.coalesce("_count", F.lit(0))
    if initial is not None:
        rows = rows.join(initial.withColumn("_listed", F.lit(True)), [*keys, "ip"], "left")
        base = F.when(F.col("_listed"), F.lit(BLOCKED)).otherwise(base)
    rows = rows.withColumn("start", base.cast("int")).select(*keys, "ip", "seq", "epoch", "kind", "start")
    return write_table(rows, "commands")


def _listed(rows: DataFrame, blocked: DataFrame, orders: DataFrame | None, keys: list[str]) -> DataFrame:
    """The addresses blocked from the start, with all scope columns. A list
    without them holds in every scope where the address occurs."""
    on = [c for c in keys if c in blocked.columns]
    named = blocked.select(*on, "ip").distinct()
    if on != keys:
        seen = rows.select(*keys, F.col("source_ip").alias("ip")).union(rows.select(*keys, F.col("destination_ip").alias("ip")))
        seen = seen if orders is None else seen.union(orders.select(*keys, "ip"))
        named = seen.join(named, [*on, "ip"], "left_semi").distinct()
    return write_table(named.select(*keys, "ip"), "listed")


def _next(state: int, kind: str, limit: int) -> int:
    """An address after one event: its open warnings, or BLOCKED."""
    if kind in ("manual", "block"):
        return BLOCKED
    if kind == "both":
        return 0
    if kind == "unblock":
        return max(state, 0)
    return state if state == BLOCKED else BLOCKED if state + 1 >= limit else state + 1


def _slice_map(keys: list[str], limit: int):
    """Where each possible state goes over one slice of an address's events."""
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [BLOCKED, *range(limit)]
        ends = list(states)
        for kind in pdf.sort_values("_i")["kind"]:
            ends = [_next(s, kind, limit) for s in ends]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in [*keys, "ip", "_slice"]}, "start": [pdf["start"].iloc[0]], "ends": [ends]})
    return scan


def _slice_starts(keys: list[str], limit: int):
    """The state at the start of each slice: the maps, one after the other."""
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        state, starts = int(pdf["start"].iloc[0]), []
        for ends in pdf["ends"]:
            starts.append(state)
            state = int(ends[min(state, limit - 1) + 1])
        return pd.DataFrame({**{c: pdf[c] for c in [*keys, "ip", "_slice"]}, "start": starts})
    return scan


def _slice_facts(keys: list[str], limit: int):
    """The facts of one slice, from the state at its start."""
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        state, found = int(pdf["start"].iloc[0]), []
        if state == BLOCKED and pdf["_slice"].iloc[0] == 0:
            found.append(("from", 0, -1, None))
        for kind, seq, epoch in zip(pdf["kind"], pdf["seq"], pdf["epoch"]):
            before, state = state, _next(state, kind, limit)
            if kind == "recon" and before != BLOCKED:
                found.append(("step", epoch, seq, before + 1))
            if state == BLOCKED and kind in ("manual", "unblock", "both"):
                found.append(("from", epoch, seq - 1, None))  # a command works on the packet of its own number
            elif state == BLOCKED and before != BLOCKED:
                found.append(("from", epoch, seq, None))      # a trigger on the next
        if pdf["_last"].iloc[0]:
            found.append(("end", None, None, state))
        out = pd.DataFrame(found, columns=["what", "epoch", "at", "step"]).astype({"epoch": "Int64", "at": "Int64", "step": "Int32"})
        for c in [*keys, "ip"]:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "ip", "what", "epoch", "at", "step"]]
    return scan


def _commanded(orders: DataFrame, hits: DataFrame, keys: list[str], schema: T.StructType, cfg: Config) -> DataFrame:
    """Facts on addresses with commands. Events are commands and at most a
    handful of packets between two; an address with many is cut into slices,
    each first summed up as a map from state to state."""
    who = [*keys, "ip"]
    events = orders.withColumn("rank", F.lit(0)).unionByName(
        hits.withColumns({"rank": F.lit(1), "start": F.lit(None).cast("int")}))
    events = numbered(events, who, ["seq", "rank"], "_i", cfg.slice_rows)
    events = events.withColumn("_slice", F.floor((F.col("_i") - 1) / F.lit(cfg.slice_rows)).cast("long"))
    starts = orders.groupBy(*who).agg(F.first("start").alias("_start"))
    sizes = events.groupBy(*who).agg(F.max("_slice").alias("_top"))
    events = events.drop("start").join(starts, who).join(sizes, who)
    events = write_table(events.withColumns({"start": F.col("_start"), "_last": F.col("_slice") == F.col("_top")}).drop("_start"), "events")
    head = [events.schema[c] for c in who]
    at_slice = T.StructType([*head, events.schema["_slice"]])
    sliced = events.filter("_top > 0")
    if sliced.head(1):
        ends = T.StructType([*at_slice.fields, T.StructField("start", T.IntegerType()), T.StructField("ends", T.ArrayType(T.IntegerType()))])
        maps = write_table(sliced.groupBy(*who, "_slice").applyInPandas(_slice_map(keys, cfg.recon_limit), ends), "slices")
        first = T.StructType([*at_slice.fields, T.StructField("start", T.IntegerType())])
        begun = maps.groupBy(*who).applyInPandas(_slice_starts(keys, cfg.recon_limit), first)
        events = events.filter("_top = 0").unionByName(sliced.drop("start").join(begun, [*who, "_slice"]), allowMissingColumns=True)
    return events.groupBy(*who, "_slice").applyInPandas(_slice_facts(keys, cfg.recon_limit), schema)


def replay_response(
    rows: DataFrame,
    blocked: DataFrame | None = None,
    warnings: DataFrame | None = None,
    commands: DataFrame | None = None,
    scope: tuple[str, ...] = ("sensor_id",),
    order: str = "seq",
    cfg: Config = DEFAULT,
) -> Replay:
    """Replay decided packets against the blocklist they themselves build up.

    ``rows``      decided and classified packets; ``order`` is unique and
                  rising within a scope. Read more than once, so store it first.
    ``blocked``   addresses blocked before the first packet: ``ip`` and,
                  optionally, the scope columns.
    ``warnings``  open reconnaissance counts: scope columns, ``ip``, ``count``.
    ``commands``  manual changes: scope columns, ``ip``, ``op`` (block or
                  unblock) and ``at_seq``, in force from that packet on. A block
                  and an unblock at one packet leave the address unblocked.
    """
    keys = list(scope)
    rows, rejects = split_rejects(rows, cfg)
    schema = T.StructType([rows.schema[c] for c in keys] + T.StructType.fromDDL(FACTS).fields)
    commands = None if commands is None else write_table(commands.select(*keys, "ip", "op", "at_seq"), "given")
    listed = None if blocked is None else _listed(rows, blocked, commands, keys)
    orders = None if commands is None else _orders(commands, listed, warnings, keys, cfg.slice_rows)

    cands = rows.withColumn("kind", trigger(cfg)).filter(F.col("kind").isNotNull()).select(
        *keys, F.col(order).cast("long").alias("seq"), F.col("source_ip").alias("src"),
        F.col("destination_ip").alias("dst"), "kind")
    for side in ("src", "dst"):
        cands = _epochs(cands, orders, keys, side, "seq", cfg.slice_rows)
    first = Window.partitionBy(*keys, "src", "dst", "epoch_src", "epoch_dst", "kind").orderBy("seq")
    pairs = cands.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= cfg.recon_limit)
    pairs = pairs.filter((F.col("kind") == "recon") | (F.col("n") == 1)).drop("n")
    fixed = None
    if listed is not None:
        # an address blocked from the start and never commanded sets off nothing
        fixed = listed if orders is None else listed.join(orders.select(*keys, "ip"), [*keys, "ip"], "left_anti")
        for side in ("src", "dst"):
            pairs = pairs.join(fixed.withColumnRenamed("ip", side), [*keys, side], "left_anti")
    base = F.lit(0)
    if warnings is not None:
        pairs = pairs.join(warnings.select(*keys, F.col("ip").alias("src"), F.col("count").cast("int").alias("_base")), [*keys, "src"], "left")
        base = F.coalesce("_base", F.lit(0))
    pairs = write_table(pairs.withColumn("base", base).drop("_base"), "triggers")

    facts = write_table(_found(pairs, None, orders, keys, schema, cfg), "facts")
    delta = facts.filter("what = 'from'").select(*keys, "ip", "epoch", F.lit(None).cast("long").alias("old"), F.col("at").alias("new"))
    rounds, worked = 1, []
    while True:
        touched = write_table(_flipped(pairs, delta, keys).select(*keys, F.col("src").alias("ip")).distinct(), "touched")
        count = touched.count()
        if count == 0:
            break
        rounds, worked = rounds + 1, [*worked, count]
        theirs = pairs.join(touched.withColumnRenamed("ip", "src"), [*keys, "src"], "left_semi")
        some = None if orders is None else orders.join(touched, [*keys, "ip"], "left_semi")
        found = write_table(_found(theirs, facts, some, keys, schema, cfg), "found")
        gone = facts.join(touched, [*keys, "ip"], "left_semi")
        at = [*keys, "ip", "epoch"]
        old = gone.filter("what = 'from'").select(*at, F.col("at").alias("old"))
        delta = write_table(old.join(found.filter("what = 'from'").select(*at, F.col("at").alias("new")), at, "full").filter("NOT (old <=> new)"), "delta")
        facts = write_table(facts.join(touched, [*keys, "ip"], "left_anti").unionByName(found), "facts")

    ends = facts.filter("what = 'end'").select(*keys, "ip", F.greatest("step", F.lit(0)).alias("open_warnings"), (F.col("step") == BLOCKED).alias("blocked"))
    if orders is None:
        state = ends.withColumn("commanded", F.lit(False))
    else:
        named = orders.select(*keys, "ip", F.lit(True).alias("commanded")).distinct()
        state = ends.join(named, [*keys, "ip"], "left").withColumn("commanded", F.coalesce("commanded", F.lit(False)))
    return Replay(_act(rows, facts, fixed, orders, keys, order, cfg), state, facts, rejects, rounds, worked)


def _flipped(pairs: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Triggers that are valid before a change and not after it, or the other way."""
    at_dst = delta.withColumnsRenamed({"ip": "dst", "epoch": "epoch_dst"})
    late = lambda c: is_true(F.col("seq") > F.col(c))
    return pairs.join(at_dst, [*keys, "dst", "epoch_dst"]).filter(late("old") != late("new"))


def _found(pairs: DataFrame, facts: DataFrame | None, orders: DataFrame | None, keys: list[str], schema: T.StructType, cfg: Config) -> DataFrame:
    """The facts that the triggers valid under ``facts`` lead to."""
    seq, limit = F.col("seq"), cfg.recon_limit
    valid = pairs
    if facts is not None:
        at_dst = facts.filter("what = 'from'").select(*keys, F.col("ip").alias("dst"), F.col("epoch").alias("epoch_dst"), F.col("at").alias("_from"))
        valid = pairs.join(at_dst, [*keys, "dst", "epoch_dst"], "left").filter(F.col("_from").isNull() | (seq <= F.col("_from"))).drop("_from")
    first = Window.partitionBy(*keys, "src", "epoch_src", "kind").orderBy("seq")
    valid = valid.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit)

    free = valid.filter(F.col("epoch_src") < 0).groupBy(*keys, F.col("src").alias("ip")).agg(
        F.min(F.when(F.col("kind") == "block", seq)).alias("at_once"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "recon", seq))).alias("ladder"),
        F.max("base").alias("base"),
    )
    free = free.withColumn("top", F.get("ladder", F.greatest(F.lit(limit) - F.col("base"), F.lit(1)) - 1))
    free = free.withColumn("t", F.least("at_once", "top"))
    free = free.withColumn("climbed", F.filter("ladder", lambda s: F.col("t").isNull() | (s <= F.col("t"))))
    free = free.withColumn("climbed", F.filter(
        "climbed", lambda s, i: i + F.col("base") < F.greatest(F.lit(limit), F.col("base") + 1)))

    def fact(what: str, at: Column, step: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), F.lit(-1).cast("long").alias("epoch"), at.cast("long").alias("at"), step.cast("int").alias("step"))

    none = F.lit(None)
    end = F.when(F.col("t").isNull(), F.col("base") + F.size("climbed")).otherwise(F.lit(BLOCKED))
    facts_of = F.concat(
        F.transform("climbed", lambda s, i: fact("step", s, i + F.col("base") + 1)),
        F.filter(F.array(fact("from", F.col("t"), none)), lambda x: x.at.isNotNull()),
        F.array(fact("end", none, end)))
    free = free.select(*keys, "ip", F.inline(facts_of)).to(schema)
    if orders is None:
        return free
    hits = valid.filter(F.col("epoch_src") >= 0).select(*keys, F.col("src").alias("ip"), "seq", F.col("epoch_src").alias("epoch"), "kind")
    return free.unionByName(_commanded(orders, hits, keys, schema, cfg))


def _act(rows, facts, fixed, orders, keys, order, cfg) -> DataFrame:
    """Actions of all packets: a join by source and one by destination. What a
    source has in one epoch is one row with at most a few warnings."""
    columns = rows.columns
    seq = F.col(order).cast("long")
    at = [*keys, "ip", "epoch"]
    known = facts.filter("what <> 'end'").groupBy(*at).agg(
        F.max(F.when(F.col("what") == "from", F.col("at"))).alias("_from"),
        F.collect_list(F.when(F.col("what") == "step", F.struct("at", "step"))).alias("_steps"))
    if fixed is not None:
        known = known.unionByName(fixed.withColumns({
            "epoch": F.lit(-1).cast("long"), "_from": F.lit(-1).cast("long"), "_steps": F.array().cast("array<struct<at:bigint,step:int>>")}))
    known = write_table(known, "known")
    for side in ("source_ip", "destination_ip"):
        rows = _epochs(rows, orders, keys, side, order, cfg.slice_rows)
    src = known.select(*keys, F.col("ip").alias("source_ip"), F.col("epoch").alias("epoch_source_ip"), F.col("_from").alias("_src_from"), "_steps")
    dst = known.filter("_from IS NOT NULL").select(
        *keys, F.col("ip").alias("destination_ip"), F.col("epoch").alias("epoch_destination_ip"), F.col("_from").alias("_dst_from"))
    out = rows.join(src, [*keys, "source_ip", "epoch_source_ip"], "left").join(dst, [*keys, "destination_ip", "epoch_destination_ip"], "left")
    out = out.withColumns({
        "blocked_before": is_true(seq > F.col("_src_from")) | is_true(seq > F.col("_dst_from")),
        "recon_step": F.get(F.filter("_steps", lambda s: s.at == seq), F.lit(0)).step,
    })
    return select_action(out, cfg).select(*columns, "action", "response_note")


def final_blocklist(replay: Replay, blocked: DataFrame | None = None, scope: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """Addresses blocked after the last packet, from the replay and from before."""
    keys = list(scope)
    now = replay.state.filter("blocked").select(*keys, "ip")
    if blocked is None:
        return now
    on = [c for c in keys if c in blocked.columns] + ["ip"]
    released = replay.state.filter("commanded and not blocked").select(*on).distinct()
    kept = blocked.select(*on).distinct().join(released, on, "left_anti")
    return now.unionByName(kept, allowMissingColumns=True).distinct()


def final_warnings(replay: Replay, warnings: DataFrame | None = None, scope: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """Open reconnaissance counts after the last packet."""
    keys = [*scope, "ip"]
    seen = replay.state.filter(F.col("open_warnings") > 0).select(*keys, F.col("open_warnings").alias("count"))
    if warnings is None:
        return seen
    untouched = warnings.select(*keys, F.col("count").cast("int").alias("count")).join(
        replay.state.select(*keys), keys, "left_anti")
    return seen.unionByName(untouched)


def watchlist(warnings: DataFrame, k: int = 3) -> DataFrame:
    """The addresses closest to a block."""
    return warnings.orderBy(F.desc("count"), "ip").limit(k)
