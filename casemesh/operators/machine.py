"""State machines over ordered events, exact for any number of events per key.

A stretch of events turns every possible starting state into one end state. Long keys are cut into stretches,
the stretches are reduced to such tables side by side, chained, and then replayed with known starting states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators.ordered import ordered_scan
from casemesh.session import cut_lineage

STRETCH_BITS = 20


def apply_moves(events: DataFrame, moves: Sequence[tuple[str, str, str]], states: Sequence[str], initial: DataFrame,
                key: str = "case_id", order: str = "seq", blocked: str | None = None,
                bits: int = STRETCH_BITS) -> DataFrame:
    """``(key, order, action, from_state, accepted, to_state, reason)`` for every event.

    ``initial`` holds ``(key, state)``; a null state is the first of ``states``. Events of keys it lacks are refused
    with ``case_not_found`` and have no states. An event whose ``blocked`` column is not null is refused with that
    reason and changes nothing.
    """
    table = {(a, action): b for a, action, b in moves}
    known = list(states)
    stretch = F.shiftright(F.col(order).cast("long"), bits)
    slim = events.select(
        F.col(key).alias("k"), F.col(order).cast("long").alias("o"), stretch.alias("stretch"), "action",
        (F.col(blocked) if blocked else F.lit(None).cast("string")).alias("why"))

    def ends_step(ends, row):
        if not isinstance(row.why, str):
            ends = tuple(table.get((s, row.action), s) for s in ends)
        return ends, []

    kt = events.schema[key].dataType.simpleString()
    ends = ordered_scan(slim, ["k", "stretch"], ["o"], lambda row: tuple(known), ends_step,
                        f"k {kt}, stretch BIGINT, ends ARRAY<STRING>",
                        at_end=lambda row, ends: [(row.k, row.stretch, list(ends))])
    first = F.coalesce("state", F.lit(known[0])).alias("first_state")
    started = ends.join(initial.select(F.col(key).alias("k"), first), "k", "left")

    def chain_start(row):
        return row.first_state if isinstance(row.first_state, str) else None

    def chain_step(state, row):
        after = row.ends[known.index(state)] if state in known else state
        return after, [(row.k, row.stretch, state)]

    starts = ordered_scan(started, ["k"], ["stretch"], chain_start, chain_step,
                          f"k {kt}, stretch BIGINT, state STRING")
    replay = slim.join(starts, ["k", "stretch"])

    def replay_step(state, row):
        if state is None:
            return None, [(row.k, row.o, row.action, None, False, None, "case_not_found")]
        to = None if isinstance(row.why, str) else table.get((state, row.action))
        reason = None if to else (row.why if isinstance(row.why, str) else "illegal_move")
        out = (row.k, row.o, row.action, state, to is not None, to or state, reason)
        return to or state, [out]

    done = ordered_scan(
        replay, ["k", "stretch"], ["o"],
        lambda row: row.state if isinstance(row.state, str) else None, replay_step,
        f"k {kt}, o BIGINT, action STRING, from_state STRING, accepted BOOLEAN, to_state STRING, reason STRING")
    return done.withColumnRenamed("k", key).withColumnRenamed("o", order)


def final_states(applied: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    return applied.groupBy(key).agg(
        F.max_by("to_state", order).alias("state"), F.count_if("accepted").alias("accepted_events"),
        F.count_if(~F.col("accepted")).alias("rejected_events"))


def apply_bail(events: DataFrame, initial: DataFrame, **options) -> DataFrame:
    """Bail track: events ``arrest, application, hearing, order_grant, order_deny, surety``."""
    return apply_moves(events, K.BAIL_MOVES, K.BAIL_STATES, initial, **options)


def gate_events(events: DataFrame, gate: DataFrame) -> DataFrame:
    """Refusal reasons of investigation events: an unmet stage gate, or a verdict that is not one.

    ``gate`` is the result of ``charge_sheet_ready``. ``verdict`` is optional on the events.
    """
    unmet = gate.filter(F.size("missing_items") > 0).select("case_id", F.lit(True).alias("_unmet"))
    said = F.lower(F.trim(F.col("verdict"))) if "verdict" in events.columns else F.lit(K.VERDICTS[0])
    reason = (
        F.when((F.col("action") == "file_charge_sheet") & F.col("_unmet"), "missing_requirements")
        .when((F.col("action") == "judgment") & ~F.coalesce(said.isin(*K.VERDICTS), F.lit(False)), "bad_verdict"))
    return events.join(unmet, "case_id", "left").withColumn("blocked", reason).drop("_unmet")


def apply_case(events: DataFrame, initial: DataFrame, gate: DataFrame, **options) -> DataFrame:
    """Investigation track: ``file_charge_sheet`` (gate met), ``trial_hearing``, ``judgment``."""
    return apply_moves(cut_lineage(gate_events(events, gate)), K.CASE_MOVES, K.CASE_STATES, initial, blocked="blocked", **options)
