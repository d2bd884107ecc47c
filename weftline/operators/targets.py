"""Decoding targets, predictors by bin, episodes of behaviour, count tensors, lanes, matches of event trains and tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import align as al
from weftline.operators.history import ordered, rewards_in_block, with_runs


def target_table(trials: DataFrame, values: dict[str, str]) -> DataFrame:
    """A row per trial and target: value and whether it may be used, with the causes that bar the trial joined by ';'.

    Nine targets come from this row and the rows just before and after it, which count only as valid choices; values maps
    further targets to columns of trials; the trial's places in session and block and its rewards in the block are
    worked out here. A trial takes part when it has a choice, no manual reward and a value.
    """
    w = ordered()
    rows = rewards_in_block(trials).withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.row_number().over(ordered("session", "block_run")) - 1)
    near = {"prev": F.lag, "next": F.lead}
    for name, f in near.items():
        rows = rows.withColumn(f"_{name}_ok", F.coalesce(f("valid").over(w), F.lit(False))).withColumn(f"_{name}_action", f("action").over(w)).withColumn(f"_{name}_reward", f("reward").over(w))
    prev, then, ok = F.col("_prev_ok"), F.col("_next_ok"), F.col("valid")
    found: dict[str, Column] = {
        "current_state": F.col("state"), "current_action": F.col("action"), "current_action_is_correct": F.col("correct"), "current_reward": F.col("reward"),
        "previous_action": F.when(prev, F.col("_prev_action")), "previous_action_was_rewarded": F.when(prev, F.col("_prev_reward")), "next_action": F.when(then, F.col("_next_action")),
        "current_choice_switch_stay": F.when(ok & prev, (F.col("action") != F.col("_prev_action")).cast("int")),
        "next_choice_switch_stay": F.when(ok & then, (F.col("action") != F.col("_next_action")).cast("int")),
        "session_trial_index": F.col("_i"), "trial_index_in_block": F.col("_b"), "rewards_in_block": F.col("rewards_in_block"),
    }
    found |= {name: F.col(column) for name, column in values.items()}
    reason = F.concat_ws(";", F.when(F.col("manual") != 0, "manual_reward"), F.when(F.col("action").isNull(), "no_animal_choice"))
    each = F.array(*[F.struct(F.lit(name).alias("target"), c.cast("double").alias("value")) for name, c in found.items()])
    out = rows.select("session", "seq", reason.alias("reason"), F.inline(each))
    return out.withColumn("usable", (F.col("reason") == "") & F.col("value").isNotNull())


#: The outcome columns, in their fixed order.
OUTCOMES = ("left_reward", "right_reward", "left_omission", "right_omission", "left_incorrect", "right_incorrect")


def choice_outcome(trials: DataFrame) -> DataFrame:
    """Outcome of each trial and, where it has none, why. A known reward needs no correctness; a missing value is no negative outcome."""
    a, r, c = F.col("action"), F.col("reward"), F.col("correct")
    why = F.when(a.isNull(), "invalid_action").when(r.isNull(), "unknown_reward").when((r == 0) & c.isNull(), "unknown_correctness")
    kind = F.when(r == 1, "reward").when(c == 1, "omission").otherwise("incorrect")
    return trials.withColumn("outcome_reason", why).withColumn("outcome", F.when(why.isNull(), F.concat_ws("_", F.when(a == 1, "left").otherwise("right"), kind)))


def joint_predictors(trials: DataFrame, bins: int = 4) -> DataFrame:
    """A row per trial and bin of [-1, 1) around its choice: context and signed choice in all bins, six outcome columns
    that are 1 from the choice on only; a trial that is no part has null predictors and its reasons."""
    rows = choice_outcome(trials)
    base = F.concat_ws(";", F.when(F.coalesce("manual", F.lit(1)) != 0, "manual_reward"), F.when(F.col("action").isNull(), "no_animal_choice"), F.when(~F.coalesce(F.col("state").isin(0, 1), F.lit(False)), "invalid_context"), F.col("outcome_reason"))
    rows = rows.withColumn("reason", base).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    ok, after = F.col("reason") == "", (F.col("bin") >= bins // 2).cast("int")
    out = [F.when(ok, (F.col("outcome") == name).cast("int") * after).alias(name) for name in OUTCOMES]
    return rows.select("session", "seq", "bin", "reason", F.when(ok, 2 * F.col("state") - 1).alias("context"), F.when(ok, 2 * F.col("action") - 1).alias("signed_choice"), *out)


def _ahead(trials: DataFrame, most: int, number: str) -> DataFrame:
    """trials with rows, an array of this row and the most - 1 after it in the session, and what starts an episode."""
    kind = F.when((F.col("correct") == 1) & (F.col("reward") == 1), "R").when((F.col("correct") == 1) & (F.col("reward") == 0), "O").when(F.col("correct") == 0, "X")
    one = F.struct("seq", "action", "state", "block", "valid", kind.alias("kind"), F.col(number).alias("number"))
    return trials.withColumn("rows", F.collect_list(one).over(ordered().rowsBetween(0, most - 1)))


def _all(low: int, high: int, test) -> Column:
    """test of every one of rows[low:high]."""
    out = F.lit(True)
    for i in range(low, high):
        out = out & F.coalesce(test(F.get("rows", F.lit(i))), F.lit(False))
    return out


def _unbroken(length: int) -> Column:
    """The first rows have numbers that follow each other: no trial between them is left out of the table."""
    out = F.lit(True)
    for i in range(1, length):
        out = out & F.coalesce(F.get("rows", F.lit(i))["number"] == F.get("rows", F.lit(0))["number"] + i, F.lit(False))
    return out


def transitions(trials: DataFrame, most: int = 4, number: str = "trial") -> DataFrame:
    """From a rewarded right choice just before a block of the other side: x = 1 to `most` wrong repeats of the old side
    and then a rewarded choice of the new side, all valid and all in the new block: direction, x, seqs of the episode.

    The trials of an episode have numbers (`number`) that follow each other; a gap ends it, a null number is none."""
    rows = _ahead(trials, most + 2, number)
    at = lambda i: F.get("rows", F.lit(i))
    old = at(0)["action"]
    start = (at(0)["kind"] == "R") & (at(0)["state"] == old) & (at(1)["block"] != at(0)["block"]) & at(0)["valid"]
    found = []
    for x in range(1, most + 1):
        new = _all(1, x + 2, lambda r: r["valid"] & (r["block"] == at(1)["block"]) & (r["state"] == 1 - old))
        wrong = _all(1, x + 1, lambda r: (r["kind"] == "X") & (r["action"] == old))
        found.append(F.when(start & _unbroken(x + 2) & new & wrong & (at(x + 1)["kind"] == "R") & (at(x + 1)["action"] == 1 - old), F.struct(F.lit(x).alias("x"), F.slice(F.col("rows")["seq"], 1, x + 2).alias("seqs"))))
    out = rows.select("session", F.when(old == 1, "left_to_right").otherwise("right_to_left").alias("direction"), F.explode(F.array_compact(F.array(*found))).alias("e"))
    return out.select("session", "direction", "e.x", "e.seqs")


def probes(trials: DataFrame, rewarded_return: bool = True, number: str = "trial") -> DataFrame:
    """Episodes that begin with a rewarded right choice R on side A, all of valid neighbours: family, side, x, seqs.

    probe: R, x = 1 to 4 wrong on B, return to A in one block; omission_probe: R, an omission on A, x wrong on B, return;
    lucky_omission_switch: R, an omission on A, then a new block and R on B; indecisive_transition: R, a new block, x = 1
    to 3 wrong on A, R on B, wrong on A, R on B. The return is rewarded, or may be an omission. Episodes may overlap.
    The trials of an episode have numbers (`number`) that follow each other.
    """
    rows = _ahead(trials, 7, number)
    at = lambda i: F.get("rows", F.lit(i))
    a = at(0)["action"]
    b = 1 - a
    is_ = lambda i, kind, side: F.coalesce((at(i)["kind"] == kind) & (at(i)["action"] == side), F.lit(False))
    back = lambda i: is_(i, "R", a) if rewarded_return else is_(i, "R", a) | is_(i, "O", a)
    same = lambda low, high, i, state: _all(low, high, lambda r: (r["block"] == at(i)["block"]) & (r["state"] == state))
    wrong = lambda low, high, side: _all(low, high, lambda r: (r["kind"] == "X") & (r["action"] == side))
    start = is_(0, "R", a) & (at(0)["state"] == a)
    found = []

    def add(family: str, x: int | None, length: int, test: Column) -> None:
        episode = F.struct(F.lit(family).alias("family"), F.lit(x).cast("int").alias("x"), F.slice(F.col("rows")["seq"], 1, length).alias("seqs"))
        found.append(F.when(start & _unbroken(length) & _all(0, length, lambda r: r["valid"]) & test, episode))

    for x in range(1, 5):
        add("probe", x, x + 2, same(0, x + 2, 0, a) & wrong(1, x + 1, b) & back(x + 1))
        add("omission_probe", x, x + 3, same(0, x + 3, 0, a) & is_(1, "O", a) & wrong(2, x + 2, b) & back(x + 2))
    add("lucky_omission_switch", None, 3, (at(0)["block"] == at(1)["block"]) & (at(1)["block"] != at(2)["block"]) & (at(1)["state"] == a) & (at(2)["state"] == b) & is_(1, "O", a) & is_(2, "R", b))
    for x in range(1, 4):
        add("indecisive_transition", x, x + 4, (at(0)["block"] != at(1)["block"]) & same(1, x + 4, 1, b) & wrong(1, x + 1, a) & is_(x + 1, "R", b) & is_(x + 2, "X", a) & is_(x + 3, "R", b))
    out = rows.select("session", F.when(a == 1, "left").otherwise("right").alias("side"), F.explode(F.array_compact(F.array(*found))).alias("e"))
    return out.select("session", "e.family", "side", "e.x", "e.seqs")


def count_tensor(points: DataFrame, centres: DataFrame, coverage: DataFrame, low: int, bins: int, width: int, unit: str = "unit") -> DataFrame:
    """Counts by centre, bin and unit over half-open bins, zero-filled, for centres whose whole window lies inside the
    session's coverage (session, start, stop). Units are those of the session's points."""
    high = low + bins * width
    whole = centres.join(coverage, "session").where((F.col("t0") + low >= F.col("start")) & (F.col("t0") + high <= F.col("stop"))).select("session", "ref", "t0")
    rel = al.interval_join(points, whole, low, high - 1)
    counts = rel.groupBy("session", "ref", F.floor((F.col("rel") - low) / width).cast("int").alias("bin"), unit).agg(F.count("*").alias("n"))
    dense = whole.select("session", "ref").join(points.select("session", unit).distinct(), "session").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return dense.join(counts, ["session", "ref", "bin", unit], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def packed_tensor(tensor: DataFrame, unit: str = "unit") -> DataFrame:
    """One row a centre and bin with the counts of the session's units as an array, in the order of the units."""
    return tensor.groupBy("session", "ref", "bin").agg(F.transform(F.sort_array(F.collect_list(F.struct(unit, "n"))), lambda s: s["n"]).alias("counts"))


def interval_match(source: DataFrame, target: DataFrame, tolerance: float, key: str = "session") -> DataFrame:
    """By key the first place (from 0) in source where its next intervals all agree with target's within the tolerance.

    Both are (key, t). Keys without such a place, or with fewer than two target events, have no row. Each target interval
    meets the source intervals that agree with it, by buckets of its length; places that all of them name are matches.
    """
    w = Window.partitionBy(key).orderBy("t")
    gap = lambda df: df.select(key, (F.row_number().over(w) - 1).alias("i"), (F.lead("t").over(w) - F.col("t")).alias("gap")).where("gap IS NOT NULL")
    width = max(2 * tolerance, 1e-9)
    mine, theirs = gap(source).withColumn("b", F.floor(F.col("gap") / width)), gap(target)
    needed = theirs.groupBy(key).agg(F.count("*").alias("needed"))
    low, high = F.floor((F.col("gap") - tolerance) / width), F.floor((F.col("gap") + tolerance) / width)
    asked = theirs.select(key, F.col("i").alias("j"), F.col("gap").alias("want"), F.explode(F.sequence(low, high)).alias("b"))
    met = mine.join(asked, [key, "b"]).where((F.abs(F.col("gap") - F.col("want")) <= tolerance) & (F.col("i") >= F.col("j")))
    places = met.groupBy(key, (F.col("i") - F.col("j")).alias("place")).agg(F.count("*").alias("n")).join(needed, key).where("n = needed")
    return places.groupBy(key).agg(F.min("place").alias("place"))


def lanes(intervals: DataFrame, key: str = "session") -> DataFrame:
    """Half-open intervals (key, start, stop, id) in the order of their starts, each in the lowest lane that is free.

    A key's intervals come sorted and in batches; a task holds a batch and one end for each open lane.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, ends = None, []
        for b in batches:
            out = []
            for k, start, stop in zip(b[key], b["start"], b["stop"], strict=True):
                if k != of:
                    of, ends = k, []
                lane = next((i for i, e in enumerate(ends) if e <= start), len(ends))
                ends[lane : lane + 1] = [stop]
                out.append(lane)
            yield b.assign(lane=out)

    rows = intervals.select(key, "start", "stop", "id").repartition(key).sortWithinPartitions(key, "start", "id")
    return rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", lane int")


def identities_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """By session, whether two tables have the same trials (session, seq, t): as many, each of the same id at the same time."""
    both = a.select("session", "seq", F.col("t").alias("t_a"), F.lit(1).alias("in_a")).join(b.select("session", "seq", F.col("t").alias("t_b"), F.lit(1).alias("in_b")), ["session", "seq"], "full")
    good = F.coalesce((F.col("in_a") == F.col("in_b")) & F.col("t_a").eqNullSafe(F.col("t_b")), F.lit(False))
    return both.groupBy("session").agg(F.count("*").alias("n"), F.count_if(good).alias("n_same"), F.every(good).alias("matches"))


def project_mask(tensor_rows: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """The flag `name` of the full table's trials (session, seq) on the rows of a tensor (session, ref); false where it has none."""
    own = mask.select("session", F.col("seq").alias("ref"), F.col(name).alias("_m"))
    return tensor_rows.join(own, ["session", "ref"], "left").withColumn(name, F.coalesce("_m", F.lit(False))).drop("_m")


def align_readings(readings: DataFrame, anchors: DataFrame, gap: float = 0.05) -> DataFrame:
    """Readings (session, seq, sync, clock) on anchors (session, sync, clock, utc): utc by the line between a reading's
    anchor and the next one of the session, or reason: no_anchor, reset_before_sync (its clock is before its anchor's), or
    gap (no next anchor and more than `gap` seconds beyond the last)."""
    w = Window.partitionBy("session").orderBy("sync")
    a = anchors.withColumn("c2", F.lead("clock").over(w)).withColumn("u2", F.lead("utc").over(w)).withColumnRenamed("clock", "c1").withColumnRenamed("utc", "u1")
    rows = readings.join(a, ["session", "sync"], "left")
    past = F.col("clock") - F.col("c1")
    reason = F.when(F.col("c1").isNull(), "no_anchor").when(past < 0, "reset_before_sync").when(F.col("c2").isNull() & (past > gap), "gap")
    slope = F.coalesce(F.try_divide(F.col("u2") - F.col("u1"), F.col("c2") - F.col("c1")), F.lit(1.0))
    return rows.select("session", "seq", F.when(reason.isNull(), F.col("u1") + past * slope).alias("utc"), reason.alias("reason"))


def serial_messages(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines 'label,value,interval' of a serial log in columns, with their kind: sync, reading or unparsed; spaces count not."""
    part = lambda i: F.trim(F.get(F.split(line, ","), F.lit(i)))
    label, value, gap = part(0), part(1).try_cast("double"), part(2).try_cast("bigint")
    known = (F.size(F.split(line, ",")) == 3) & value.isNotNull() & gap.isNotNull() & (label != "")
    kind = F.when(~known, "unparsed").when(label == "syncPinState", "sync").otherwise("reading")
    return lines.withColumn("kind", kind).withColumn("label", F.when(known, label)).withColumn("number", F.when(known, value)).withColumn("interval", F.when(known, gap))


def sync_transitions(messages: DataFrame) -> DataFrame:
    """The sync messages (session, t, seq, kind, number) whose state differs from the sync message before."""
    sync = messages.where("kind = 'sync'").withColumn("_was", F.lag("number").over(ordered()))
    return sync.where("_was IS NULL OR _was != number").drop("_was")


def switch_counts(events: DataFrame, panel: Sequence[str] = ("wrong_to_correct", "correct_to_wrong", "wrong_to_wrong", "correct_to_correct")) -> DataFrame:
    """Events by session and transition in the panel's fixed order, 0 where there are none."""
    n = events.groupBy("session", "transition").agg(F.count("*").alias("n"))
    every = events.select("session").distinct().select("session", F.posexplode(F.array(*map(F.lit, panel))).alias("place", "transition"))
    return every.join(n, ["session", "transition"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def side_motifs(trials: DataFrame) -> DataFrame:
    """Counts of three neighbouring valid trials by the outcomes of the first two, the middle one's side, and whether the third repeats it."""
    w = ordered()
    kind = F.when((F.col("correct") == 1) & (F.col("reward") == 1), "correct_rewarded").when((F.col("correct") == 1) & (F.col("reward") == 0), "omission").when(F.col("correct") == 0, "incorrect")
    rows = trials.withColumn("central", kind)
    for name, f in (("p", F.lag), ("n", F.lead)):
        rows = rows.withColumn(f"_{name}v", f("valid").over(w)).withColumn(f"_{name}a", f("action").over(w)).withColumn(f"_{name}k", f("central").over(w))
    rows = rows.where("valid AND _pv AND _nv").where(F.when(F.col("_pk") == "incorrect", F.col("_pa") != F.col("action")).otherwise(F.col("_pa") == F.col("action")))
    move = F.when(F.col("_na") == F.col("action"), "repeat").otherwise("switch")
    return rows.groupBy("central", F.when(F.col("action") == 1, "left").otherwise("right").alias("side"), F.col("_pk").alias("previous"), move.alias("next_move")).agg(F.count("*").alias("n"))
