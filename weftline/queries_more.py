"""Further registered queries: tables of sessions, targets, signals, intervals and decoders, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import align as al
from weftline.operators import assembly as asm
from weftline.operators import batched as ba
from weftline.operators import decoding as dc
from weftline.operators import hmm
from weftline.operators import history as hi
from weftline.operators import linear as li
from weftline.operators import points as po
from weftline.operators import policies as pl
from weftline.operators import sessions as se
from weftline.operators import spectra as sp
from weftline.operators import state_choice as sc
from weftline.operators import summaries as su
from weftline.operators import targets as tg
from weftline.operators import vectors as ve
from weftline.plans.standins import table, trials, trials_of
from weftline.queries import BLOCKS, COUNTERS, HOUR, LONG, MICRO_SQL, NB, QUERIES, RUNS, SIDED, SQL, VALID, WELCH, _add, _centres, _folded, _micros, _points, _stream
from weftline.sources import tables as so
from weftline.streaming import live

__all__ = ["QUERIES", "SQL"]

REST = SIDED[len(VALID) :]  # the sided counters where VALID is there already
PLACE = "(SELECT session, seq, block_run FROM runs)"


def _valued(s: SparkSession, d: str) -> DataFrame:
    """Trials with the doubt value before each (null where not valid) and the chance that the better side pays."""
    rows = trials(s, d)
    doubt = hi.counterfactual_doubt(rows).select("session", "t", "seq", (-F.col("doubt_value")).alias("value"))
    return rows.join(doubt, ["session", "t", "seq"], "left").withColumn("p", F.when(F.col("state") == 1, 0.8).otherwise(0.5))


# Blocks and sessions.
GREEDY = """, gr AS (SELECT *, coalesce(last_value(CASE WHEN doubt_value < 0 THEN 1 WHEN doubt_value > 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS pick FROM doubt)"""
TABLE = BLOCKS + COUNTERS + REST + GREEDY + f"""
, bt AS (SELECT session, block_run, count(*) FILTER (WHERE valid AND correct = 1) AS n_correct, avg(correct) FILTER (WHERE valid) AS accuracy, avg(epoch_us(t) % 1000) FILTER (WHERE valid) AS mean_latency FROM runs GROUP BY 1, 2),
fl AS (SELECT *, coalesce(action, last_value(action IGNORE NULLS) OVER (PARTITION BY session, block_run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(action IGNORE NULLS) OVER (PARTITION BY session, block_run ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS f FROM runs),
sw AS (SELECT session, block_run, CAST(coalesce(sum((f <> pf)::INT), 0) AS BIGINT) AS n_switches FROM (SELECT *, lag(f) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS pf FROM fl) GROUP BY 1, 2),
cs AS (SELECT session, block_run, arg_min(consecutive_rewards, rn) AS c, arg_min(renewal_rewards, rn) AS m FROM counters JOIN {PLACE} USING (session, seq) GROUP BY 1, 2),
ag AS (SELECT session, block_run, avg((pick = action)::INT) AS agreement FROM gr JOIN {PLACE} USING (session, seq) GROUP BY 1, 2),
btab AS (SELECT *, coalesce(lag(n_correct) OVER w, 0) AS prev_n_correct, lag(n_rewarded / nullif(n_valid, 0)) OVER w AS prev_reward_fraction,
  CASE WHEN row_number() OVER w = 1 THEN 0 ELSE c END AS prev_consecutive_rewards, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE m END AS prev_consecutive_rewards_memory,
  n_valid - trials_to_correct AS n_after_first, n_switches > 3 AS confusion_flag
  FROM blocks JOIN bt USING (session, block_run) JOIN sw USING (session, block_run) LEFT JOIN cs USING (session, block_run) LEFT JOIN ag USING (session, block_run) WINDOW w AS (PARTITION BY session ORDER BY block_run)),
ff AS (SELECT session, block_run, avg(correct) FILTER (WHERE valid AND pos >= ttc) AS f FROM b1 GROUP BY 1, 2)"""
_add("a02_block_table", lambda s, d: se.block_table(_valued(s, d).withColumn("latency", F.unix_micros("t") % 1000), "value", "latency"),
     "session block_run n_correct ~accuracy n_switches prev_n_correct ~prev_reward_fraction prev_consecutive_rewards prev_consecutive_rewards_memory n_after_first confusion_flag ~agreement ~mean_latency", "SELECT * FROM btab", TABLE)
_add("a03_streaks", lambda s, d: se.transition_streaks(trials(s, d)), "session block_run streak",
     "SELECT session, block_run, arg_min(rn - 1 - paid, rn) FILTER (WHERE correct = 1) AS streak FROM (SELECT v.*, q.block_run, coalesce(max(CASE WHEN reward = 1 THEN rn END) OVER (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid FROM v JOIN " + PLACE + " q USING (session, seq)) GROUP BY 1, 2", RUNS + VALID)
_add("a13_bias_flags", lambda s, d: se.bias_flags(su.blocks(trials(s, d))), "session block_run rl_biased inf_biased",
     "SELECT session, block_run, (trials_to_correct - prev_n_rewarded) / (trials_to_correct + prev_n_rewarded + 1e-9) > 0.2 AS rl_biased, (trials_to_correct - 4) / (trials_to_correct + 4) > 0.2 AS inf_biased FROM blocks", BLOCKS)
POLICY = """, pol AS (SELECT session, count(*) AS n, avg((pick = state)::INT) AS policy_accuracy, avg((pick = action)::INT) AS policy_agreement, sum(CASE WHEN pick = state THEN CASE WHEN state = 1 THEN 0.8 ELSE 0.5 END ELSE 0 END)::DOUBLE AS policy_expected, sum(reward) AS got FROM gr GROUP BY 1)"""
_add("a14_session_summary", lambda s, d: se.session_summary(_valued(s, d), "p", "value"),
     "session n_valid ~left_correct ~right_correct ~overall_correct ~overall_ttc n_missing n_blocks ~zero_ttc_fraction ~median_ttc ~q3_ttc ~frac_ttc_gt_5 ~frac_after_lt_07 ~frac_agreement_lt_06 ~median_after ~q1_after collected ~expected ~oracle_difference ~p_switch_after_reward ~policy_accuracy ~policy_agreement ~policy_expected ~policy_difference ~left_ratio ~signed_bias",
     """SELECT * FROM (SELECT session, count(*) AS n_valid, avg(correct) FILTER (WHERE state = 1) AS left_correct, avg(correct) FILTER (WHERE state = 0) AS right_correct, avg(correct) AS overall_correct, sum(reward)::BIGINT AS collected, sum(CASE WHEN state = 1 THEN 0.8 ELSE 0.5 END)::DOUBLE AS expected, sum(reward) - sum(CASE WHEN state = 1 THEN 0.8 ELSE 0.5 END)::DOUBLE AS oracle_difference,
       count(*) FILTER (WHERE action = 1) / nullif(count(*) FILTER (WHERE state = 1), 0) AS left_ratio, (count(*) FILTER (WHERE action = 1) - count(*) FILTER (WHERE action = 0)) / count(*) AS signed_bias FROM v GROUP BY 1)
     LEFT JOIN (SELECT session, count(*) AS n_blocks, avg(trials_to_correct) AS overall_ttc, count(*) FILTER (WHERE trials_to_correct IS NULL AND block_run < mx) AS n_missing, avg((trials_to_correct = 0)::INT) FILTER (WHERE block_run > 1) AS zero_ttc_fraction, quantile_cont(trials_to_correct, 0.5) AS median_ttc, quantile_cont(trials_to_correct, 0.75) AS q3_ttc,
       avg((trials_to_correct > 5)::INT) AS frac_ttc_gt_5, avg((f < 0.7)::INT) AS frac_after_lt_07, avg((agreement < 0.6)::INT) AS frac_agreement_lt_06, quantile_cont(f, 0.5) AS median_after, quantile_cont(f, 0.25) AS q1_after FROM (SELECT *, max(block_run) OVER (PARTITION BY session) AS mx FROM btab) JOIN ff USING (session, block_run) GROUP BY 1) USING (session)
     LEFT JOIN (SELECT session, switches / nullif(n, 0) AS p_switch_after_reward FROM (SELECT session, count(*) FILTER (WHERE valid AND nv AND reward > 0) AS n, count(*) FILTER (WHERE valid AND nv AND reward > 0 AND na <> action) AS switches FROM nb GROUP BY 1)) USING (session)
     LEFT JOIN (SELECT *, got - policy_expected AS policy_difference FROM pol) USING (session)""", TABLE + POLICY + NB)  # fmt: skip
_add("f13_policy_summary", lambda s, d: se.policy_summary(_valued(s, d), "p", "value"), "session n ~policy_accuracy ~policy_agreement ~policy_expected ~policy_difference",
     "SELECT *, got - policy_expected AS policy_difference FROM pol", SIDED + GREEDY + POLICY)
_add("f13_value_quartiles", lambda s, d: se.value_quartiles(_valued(s, d), ["state"], "value"), "state n ~mean ~q1 ~median ~q3",
     "SELECT state, count(*) AS n, avg(-doubt_value) AS mean, quantile_cont(-doubt_value, 0.25) AS q1, quantile_cont(-doubt_value, 0.5) AS median, quantile_cont(-doubt_value, 0.75) AS q3 FROM doubt GROUP BY 1", SIDED)
DETAIL = RUNS + """, d0 AS (SELECT *, row_number() OVER w - 1 AS pos, first_value(state) OVER w AS side FROM runs WINDOW w AS (PARTITION BY session, block_run ORDER BY t, seq)),
d1 AS (SELECT session, block_run + 1 AS block_run, max(side) AS was FROM d0 GROUP BY 1, 2), d2 AS (SELECT * FROM d0 JOIN d1 USING (session, block_run) WHERE was <> side),
d3 AS (SELECT *, min(pos) FILTER (WHERE action = side) OVER (PARTITION BY session, block_run) AS f, count(action) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS c FROM d2),
d4 AS (SELECT *, count(*) FILTER (WHERE pos < f AND action IS NULL) OVER q AS skipped, count(*) FILTER (WHERE pos < f AND manual <> 0) OVER q AS paid FROM d3 WINDOW q AS (PARTITION BY session, block_run)),
d5 AS (SELECT *, CASE WHEN f IS NULL THEN 'no_switch_before_block_end' WHEN skipped > 0 THEN 'no_choice_before_switch' WHEN paid > 0 THEN 'experimenter_reward_before_switch' END AS reason,
  CASE WHEN action IS NULL THEN 'no_choice' WHEN pos > f THEN 'post_switch' WHEN action = was THEN 'stay' ELSE 'switch' END AS status FROM d4)"""
_add("a15_persistence_detail", lambda s, d: se.persistence_detail(trials(s, d)), "session seq block_run trial_after_switch choice_after_switch direction status reason counted",
     "SELECT *, pos + 1 AS trial_after_switch, CASE WHEN action IS NOT NULL THEN c END AS choice_after_switch, CASE WHEN side = 1 THEN 'right_to_left' ELSE 'left_to_right' END AS direction, reason IS NULL AND status IN ('stay', 'switch') AS counted FROM d5", DETAIL)
_add("a17_first_correct_detail", lambda s, d: se.first_correct_detail(trials(s, d)), "session seq block_run ix correct reason",
     "SELECT session, seq, block_run, CASE WHEN valid THEN n - 1 END AS ix, CASE WHEN valid THEN correct END AS correct, CASE WHEN NOT valid THEN 'not_a_valid_choice' END AS reason FROM (SELECT *, sum(valid::INT) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS n FROM (SELECT *, max((valid AND correct = 1)::INT) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS seen FROM runs) WHERE seen = 1)", RUNS)
_add("a20_window_pooled", lambda s, d: se.window_sessions(hi.greedy_choices(hi.counterfactual_doubt(trials(s, d)), "doubt_value")), "session n ~median ~pooled",
     "SELECT session, count(*) AS n, quantile_cont(a, 0.5) AS median, avg(a) AS pooled FROM (SELECT session, avg((greedy = action)::INT) AS a FROM (SELECT *, floor((rn - 1) / 10) AS win FROM greedy) GROUP BY session, win HAVING count(*) = 10) GROUP BY 1", SIDED)
_add("a21_cohort_by_type", lambda s, d: se.cohort_by_day(table(s, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v")), "user_id", ["event_type"], "v"), "event_type n ~mean",
     "SELECT event_type, count(v) AS n, avg(v) AS mean FROM (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
_add("a25_dated_series", lambda s, d: se.dated_series(table(s, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("spent")), "o_custkey", "day", "spent"), "o_custkey number ~spent",
     "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS number, spent FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS spent FROM orders GROUP BY 1, 2)")
_add("a27_centred_by_customer", lambda s, d: se.centred(table(s, d, "orders"), "o_totalprice", "o_custkey"), "o_orderkey ~centred", "SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS centred FROM orders")
_add("a29_ttc_by_rewards", lambda s, d: se.metric_by_count(su.blocks(trials(s, d)), "prev_n_rewarded", "trials_to_correct", 3), "prev_n_rewarded n ~mean ~sd ~sem",
     "SELECT prev_n_rewarded, count(trials_to_correct) AS n, avg(trials_to_correct) AS mean, stddev_samp(trials_to_correct) AS sd, stddev_samp(trials_to_correct) / sqrt(count(trials_to_correct)) AS sem FROM blocks GROUP BY 1 HAVING count(trials_to_correct) > 3", BLOCKS)
_add("a29_switch_counters", lambda s, d: se.switch_counters(trials(s, d)), "session seq kind consecutive_rewards consecutive_omissions",
     "SELECT session, seq, 'action' AS kind, consecutive_rewards, consecutive_omissions FROM (SELECT *, lag(action) OVER w AS pa FROM counters WINDOW w AS (PARTITION BY session ORDER BY rn)) WHERE pa <> action UNION ALL SELECT session, seq, 'state', consecutive_rewards, consecutive_omissions FROM (SELECT *, lag(state) OVER w AS ps FROM counters WINDOW w AS (PARTITION BY session ORDER BY rn)) WHERE ps <> state", COUNTERS)

# The recursion of the SQL walks all trials one by one; a trial that is not valid leaves the state as it is.
WALK = """, an AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS k FROM trials),
wk(session, k, seq, cr, co, rr, ro, nv, was, ol, orr, dl, dr, cl, cq, fl, fr, ml, mr) AS (
  SELECT session, 0::BIGINT, NULL::BIGINT, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM an WHERE k = 1
  UNION ALL SELECT a.session, a.k, a.seq, s.cr, s.co, s.rr, s.ro, s.nv, s.was, s.ol, s.orr, s.dl, s.dr, s.cl, s.cq, s.fl, s.fr, s.ml, s.mr FROM an a JOIN (
    SELECT w.session, w.k, CASE WHEN ok THEN CASE WHEN p THEN cr + 1 ELSE 0 END ELSE cr END AS cr, CASE WHEN ok THEN CASE WHEN p THEN 0 ELSE co + 1 END ELSE co END AS co,
      CASE WHEN ok AND p THEN CASE WHEN was = 1 THEN rr ELSE 0 END + 1 ELSE rr END AS rr, CASE WHEN ok AND NOT p THEN CASE WHEN was = 1 THEN 0 ELSE ro END + 1 ELSE ro END AS ro,
      CASE WHEN ok THEN nv + CASE WHEN p THEN -1 ELSE 1 END ELSE nv END AS nv, CASE WHEN ok THEN p::INT ELSE was END AS was,
      CASE WHEN ok AND l THEN CASE WHEN p THEN 0 ELSE ol + 1 END ELSE ol END AS ol, CASE WHEN ok AND NOT l THEN CASE WHEN p THEN 0 ELSE orr + 1 END ELSE orr END AS orr,
      CASE WHEN ok THEN CASE WHEN p THEN 0 WHEN l THEN dl + 1 ELSE dl END ELSE dl END AS dl, CASE WHEN ok THEN CASE WHEN p THEN 0 WHEN l THEN dr ELSE dr + 1 END ELSE dr END AS dr,
      CASE WHEN ok AND l THEN greatest(cl + CASE WHEN p THEN 1 ELSE -1 END, 0) ELSE cl END AS cl, CASE WHEN ok AND NOT l THEN greatest(cq + CASE WHEN p THEN 1 ELSE -1 END, 0) ELSE cq END AS cq,
      CASE WHEN ok AND l THEN greatest(fl + CASE WHEN p THEN 1 ELSE -1 END, 0) WHEN ok AND p THEN 0 ELSE fl END AS fl, CASE WHEN ok AND NOT l THEN greatest(fr + CASE WHEN p THEN 1 ELSE -1 END, 0) WHEN ok AND p THEN 0 ELSE fr END AS fr,
      CASE WHEN ok AND p THEN CASE WHEN l THEN ml + 1 ELSE 0 END ELSE ml END AS ml, CASE WHEN ok AND p THEN CASE WHEN l THEN 0 ELSE mr + 1 END ELSE mr END AS mr
    FROM wk w LEFT JOIN (SELECT session, k, valid AS ok, reward = 1 AS p, action = 1 AS l FROM an) b ON b.session = w.session AND b.k = w.k) s ON a.session = s.session AND a.k = s.k + 1)"""
_add("c06_decision_variables", lambda s, d: se.decision_variables(trials(s, d)),
     "session seq consecutive_rewards consecutive_omissions renewal_rewards renewal_omissions negative_value omissions_left omissions_right omissions_difference doubt_left doubt_right choice_left choice_right choice_difference counterfactual_left counterfactual_right counterfactual_difference monotonic_left monotonic_right monotonic_difference",
     "SELECT session, seq, cr AS consecutive_rewards, co AS consecutive_omissions, rr AS renewal_rewards, ro AS renewal_omissions, nv AS negative_value, ol AS omissions_left, orr AS omissions_right, ol - orr AS omissions_difference, dl AS doubt_left, dr AS doubt_right, cl AS choice_left, cq AS choice_right, cl - cq AS choice_difference, fl AS counterfactual_left, fr AS counterfactual_right, fl - fr AS counterfactual_difference, ml AS monotonic_left, mr AS monotonic_right, ml - mr AS monotonic_difference FROM wk WHERE k > 0", WALK)
_add("c04_sided_walk", lambda s, d: se.sided_walk(trials(s, d), counterfactual=True), "session seq value_left value_right value_difference", "SELECT session, seq, fl AS value_left, fr AS value_right, fl - fr AS value_difference FROM wk JOIN trials USING (session, seq) WHERE k > 0 AND valid", WALK)
_add("c10_signed_omissions", lambda s, d: se.signed_omissions(trials(s, d)), "session seq signed_omissions", "SELECT session, seq, consecutive_omissions * (2 * coalesce(lag(action) OVER (PARTITION BY session ORDER BY rn), 0) - 1) AS signed_omissions FROM counters", COUNTERS)

# Targets, predictors and episodes.
J18 = NB + """, rb AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) - 1 AS i, row_number() OVER (PARTITION BY session, block_run ORDER BY t, seq) - 1 AS b, coalesce(sum(CASE WHEN valid THEN reward ELSE 0 END) OVER (PARTITION BY session, block_run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rib,
  lag(reward) OVER (PARTITION BY session ORDER BY t, seq) AS pr FROM runs),
jt AS (SELECT rb.*, coalesce(pv, false) AS pv, coalesce(nb.nv, false) AS nxt, pa, na, concat_ws(';', CASE WHEN rb.manual <> 0 THEN 'manual_reward' END, CASE WHEN rb.action IS NULL THEN 'no_animal_choice' END) AS reason, consecutive_rewards AS cr, consecutive_omissions AS co, doubt_value AS dv
  FROM rb JOIN nb USING (session, seq) LEFT JOIN (SELECT session, seq, consecutive_rewards, consecutive_omissions FROM counters) USING (session, seq) LEFT JOIN (SELECT session, seq, doubt_value FROM doubt) USING (session, seq))"""


def _j18_sql() -> str:
    targets = {"current_state": "state", "current_action": "action", "current_action_is_correct": "correct", "current_reward": "reward", "previous_action": "CASE WHEN pv THEN pa END", "previous_action_was_rewarded": "CASE WHEN pv THEN pr END",
               "next_action": "CASE WHEN nxt THEN na END", "current_choice_switch_stay": "CASE WHEN valid AND pv THEN (action <> pa)::INT END", "next_choice_switch_stay": "CASE WHEN valid AND nxt THEN (action <> na)::INT END",
               "session_trial_index": "i", "trial_index_in_block": "b", "rewards_in_block": "rib", "consecutive_rewards": "cr", "consecutive_omissions": "co", "relative_doubt": "dv"}
    return " UNION ALL ".join(f"SELECT session, seq, '{n}' AS target, ({x})::DOUBLE AS value, reason, reason = '' AND ({x}) IS NOT NULL AS usable FROM jt" for n, x in targets.items())


def _targets(s: SparkSession, d: str) -> DataFrame:
    rows = trials(s, d)
    more = hi.reward_counters(rows).select("session", "t", "seq", "consecutive_rewards", "consecutive_omissions").join(hi.counterfactual_doubt(rows).select("session", "t", "seq", "doubt_value"), ["session", "t", "seq"])
    return tg.target_table(rows.join(more, ["session", "t", "seq"], "left"), {"consecutive_rewards": "consecutive_rewards", "consecutive_omissions": "consecutive_omissions", "relative_doubt": "doubt_value"})


_add("j18_target_table", _targets, "session seq target ~value reason usable", _j18_sql(), RUNS + COUNTERS + REST + J18)
_add("j20_joint_predictors", lambda s, d: tg.joint_predictors(trials(s, d)), "session seq bin reason context signed_choice left_reward right_reward left_omission right_omission left_incorrect right_incorrect",
     "SELECT session, seq, bin, reason, CASE WHEN reason = '' THEN 2 * state - 1 END AS context, CASE WHEN reason = '' THEN 2 * action - 1 END AS signed_choice, " + ", ".join(f"CASE WHEN reason = '' THEN (action = {a} AND {o} AND bin >= 2)::INT END AS {n}" for n, a, o in (("left_reward", 1, "reward = 1"), ("right_reward", 0, "reward = 1"), ("left_omission", 1, "reward = 0 AND correct = 1"), ("right_omission", 0, "reward = 0 AND correct = 1"), ("left_incorrect", 1, "reward = 0 AND correct = 0"), ("right_incorrect", 0, "reward = 0 AND correct = 0")))
     + " FROM (SELECT *, concat_ws(';', CASE WHEN manual <> 0 THEN 'manual_reward' END, CASE WHEN action IS NULL THEN 'no_animal_choice' END, CASE WHEN action IS NULL THEN 'invalid_action' END) AS reason FROM trials) CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS bin)")


def _ahead_sql(n: int) -> str:
    cols = ", ".join(f"lead({c}, {i}) OVER w AS {c}{i}" for i in range(n) for c in ("seq", "action", "state", "block", "valid", "kind", "trial"))
    return f", kd AS (SELECT *, CASE WHEN correct = 1 AND reward = 1 THEN 'R' WHEN correct = 1 AND reward = 0 THEN 'O' WHEN correct = 0 THEN 'X' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS trial FROM trials) WHERE action IS NOT NULL), ah AS (SELECT session, {cols} FROM kd WINDOW w AS (PARTITION BY session ORDER BY t, seq))"


def _is(i: int, kind: str, side: str) -> str:
    return f"kind{i} = '{kind}' AND action{i} = {side}"


def _seqs(n: int) -> str:
    return "concat_ws(',', " + ", ".join(f"seq{i}" for i in range(n)) + ")"


def _unbroken(n: int) -> str:
    return " AND ".join(f"trial{i} = trial0 + {i}" for i in range(1, n))


def _with_choice(s: SparkSession, d: str) -> DataFrame:
    """The trials with a choice, numbered before the others went: there are gaps."""
    return trials(s, d).withColumn("trial", F.row_number().over(hi.ordered())).where("action IS NOT NULL")


def _transitions_sql() -> str:
    out = []
    for x in range(1, 5):
        new = " AND ".join(f"valid{i} AND block{i} = block1 AND state{i} = 1 - action0" for i in range(1, x + 2))
        wrong = " AND ".join(_is(i, "X", "action0") for i in range(1, x + 1))
        out.append(f"SELECT session, CASE WHEN action0 = 1 THEN 'left_to_right' ELSE 'right_to_left' END AS direction, {x} AS x, {_seqs(x + 2)} AS episode FROM ah WHERE {_unbroken(x + 2)} AND kind0 = 'R' AND state0 = action0 AND valid0 AND block1 <> block0 AND {new} AND {wrong} AND {_is(x + 1, 'R', '1 - action0')}")
    return " UNION ALL ".join(out)


def _probes_sql() -> str:
    out = []

    def add(family: str, x: int | None, n: int, test: str) -> None:
        valid = " AND ".join(f"valid{i}" for i in range(n))
        out.append(f"SELECT session, '{family}' AS family, CASE WHEN action0 = 1 THEN 'left' ELSE 'right' END AS side, CAST({'NULL' if x is None else x} AS INTEGER) AS x, {_seqs(n)} AS episode FROM ah WHERE {_unbroken(n)} AND kind0 = 'R' AND state0 = action0 AND {valid} AND {test}")

    same = lambda low, high, i, state: " AND ".join(f"block{j} = block{i} AND state{j} = {state}" for j in range(low, high))
    wrong = lambda low, high, side: " AND ".join(_is(j, "X", side) for j in range(low, high))
    a, b = "action0", "1 - action0"
    for x in range(1, 5):
        add("probe", x, x + 2, f"{same(0, x + 2, 0, a)} AND {wrong(1, x + 1, b)} AND {_is(x + 1, 'R', a)}")
        add("omission_probe", x, x + 3, f"{same(0, x + 3, 0, a)} AND {_is(1, 'O', a)} AND {wrong(2, x + 2, b)} AND {_is(x + 2, 'R', a)}")
    add("lucky_omission_switch", None, 3, f"block0 = block1 AND block1 <> block2 AND state1 = {a} AND state2 = {b} AND {_is(1, 'O', a)} AND {_is(2, 'R', b)}")
    for x in range(1, 4):
        add("indecisive_transition", x, x + 4, f"block0 <> block1 AND {same(1, x + 4, 1, b)} AND {wrong(1, x + 1, a)} AND {_is(x + 1, 'R', b)} AND {_is(x + 2, 'X', a)} AND {_is(x + 3, 'R', b)}")
    return " UNION ALL ".join(out)




def _episode(df: DataFrame) -> DataFrame:
    return df.withColumn("episode", F.array_join(F.col("seqs").cast("array<string>"), ","))


_add("j15_transitions", lambda s, d: _episode(tg.transitions(_with_choice(s, d))), "session direction x episode", _transitions_sql(), _ahead_sql(6))
_add("j15_probes", lambda s, d: _episode(tg.probes(_with_choice(s, d))), "session family side x episode", _probes_sql(), _ahead_sql(7))
_add("j14_side_motifs", lambda s, d: tg.side_motifs(trials(s, d)), "central side previous next_move n",
     "SELECT k AS central, CASE WHEN action = 1 THEN 'left' ELSE 'right' END AS side, pk AS previous, CASE WHEN na = action THEN 'repeat' ELSE 'switch' END AS next_move, count(*) AS n FROM (SELECT *, lag(action) OVER w AS pa, lead(action) OVER w AS na, lag(valid) OVER w AS pv, lead(valid) OVER w AS nv, lag(k) OVER w AS pk FROM (SELECT *, CASE WHEN correct = 1 AND reward = 1 THEN 'correct_rewarded' WHEN correct = 1 THEN 'omission' WHEN correct = 0 THEN 'incorrect' END AS k FROM trials) WINDOW w AS (PARTITION BY session ORDER BY t, seq)) WHERE valid AND pv AND nv AND CASE WHEN pk = 'incorrect' THEN pa <> action ELSE pa = action END GROUP BY ALL")
_add("j16_switch_counts", lambda s, d: tg.switch_counts(hi.switch_events(trials(s, d))), "session place transition n",
     "SELECT session, place, transition, count(x) AS n FROM (SELECT DISTINCT session FROM sw) CROSS JOIN (SELECT * FROM (VALUES (0, 'wrong_to_correct'), (1, 'correct_to_wrong'), (2, 'wrong_to_wrong'), (3, 'correct_to_correct')) p(place, transition)) LEFT JOIN (SELECT session, transition, 1 AS x FROM sw) USING (session, transition) GROUP BY ALL", NB + ", sw AS (SELECT session, CASE WHEN correct = 1 THEN 'correct' ELSE 'wrong' END || '_to_' || CASE WHEN nc = 1 THEN 'correct' ELSE 'wrong' END AS transition FROM nb WHERE valid AND nv AND na <> action)")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).groupBy("session").agg(F.min("t").alias("start"), F.max("t").alias("stop"))


_add("j06_count_tensor", lambda s, d: tg.count_tensor(_points(s, d), _centres(s, d), _coverage(s, d), -6 * HOUR, 12, HOUR), "session ref bin unit n",
     f"SELECT session, ref, bin, unit, count(t) AS n FROM (SELECT ct.*, bin, unit FROM ct JOIN (SELECT session, min(t) AS a, max(t) AS b FROM pt GROUP BY 1) USING (session) JOIN (SELECT DISTINCT session, unit FROM pt) USING (session) CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS bin) WHERE t0 - {6 * HOUR} >= a AND t0 + {6 * HOUR} <= b) g LEFT JOIN pt p USING (session, unit) GROUP BY ALL".replace("count(t)", f"count(*) FILTER (WHERE t >= t0 - {6 * HOUR} + bin * {HOUR} AND t < t0 - {6 * HOUR} + (bin + 1) * {HOUR})").replace("GROUP BY ALL", "GROUP BY session, ref, t0, bin, unit"), MICRO_SQL)


def _seconds(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).groupBy("session", (F.col("t") / al.MICROS).alias("t")).agg(F.min("seq").alias("seq"))


def _third(s: SparkSession, d: str) -> DataFrame:
    """The third to sixth event of each session."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("t"))
    return _seconds(s, d).withColumn("n", n).where("n BETWEEN 3 AND 6")


_add("j05_interval_match", lambda s, d: tg.interval_match(_seconds(s, d), _third(s, d), 0.01), "session place",
     "SELECT session, min(i - 1) AS place FROM (SELECT a.session, a.n AS i FROM sn a JOIN sn b ON a.session = b.session JOIN sn c ON c.session = a.session AND c.n = b.n - a.n + 3 WHERE b.n BETWEEN a.n + 1 AND a.n + 3 AND c.n BETWEEN 4 AND 6 AND abs((b.t - b.p) - (c.t - c.p)) <= 0.01 GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM sn z WHERE z.session = a.session AND z.n BETWEEN 4 AND 6)) GROUP BY 1", MICRO_SQL + ", sn AS (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY t) AS p FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t) AS n FROM (SELECT DISTINCT session, t / 1000000 AS t FROM pt)))")


def _spans(s: SparkSession, d: str) -> DataFrame:
    """An interval of up to three days for each event."""
    return _points(s, d).select("session", F.col("t").alias("start"), (F.col("t") + (F.col("seq") % 3 + 1) * 24 * HOUR).alias("stop"), F.col("seq").alias("id"))


SPANS = MICRO_SQL + f", ss AS (SELECT session, t AS start, t + (seq % 3 + 1) * {24 * HOUR} AS stop, seq AS id FROM pt)"
_add("j11_lanes", lambda s, d: tg.lanes(_spans(s, d)), "session id lane",
     "SELECT session, id, lane - 1 AS lane FROM ln WHERE k > 0", SPANS + """, so AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start, id) AS k FROM ss),
ln(session, k, id, lane, ends) AS (SELECT session, 0::BIGINT, NULL::BIGINT, 0, []::BIGINT[] FROM so WHERE k = 1 UNION ALL SELECT session, k, id, lane, ends[1 : lane - 1] || [stop] || ends[lane + 1 :] FROM (SELECT o.session, o.k, o.id, o.stop, l.ends, CAST(coalesce(list_position([e <= o.start FOR e IN l.ends], true), len(l.ends) + 1) AS INTEGER) AS lane FROM ln l JOIN so o ON o.session = l.session AND o.k = l.k + 1))""")  # fmt: skip
_add("j12_identities", lambda s, d: tg.identities_match(trials(s, d), trials(s, d).where("seq % 97 != 0 OR session % 2 = 0")), "session n n_same matches",
     "SELECT session, count(*) AS n, count(*) FILTER (WHERE g) AS n_same, bool_and(g) AS matches FROM (SELECT session, seq % 97 <> 0 OR session % 2 = 0 AS g FROM trials) GROUP BY 1")


def _readings(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), n.alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("clock")).withColumn("sync", F.floor(F.col("n") / 5))


def _t14(s: SparkSession, d: str) -> DataFrame:
    rows = _readings(s, d)
    anchors = rows.where("n % 5 = 2").select("session", "sync", "clock", (F.col("clock") * 1.0001 + 5).alias("utc"))
    return tg.align_readings(rows, anchors, 60.0).withColumn("utc", F.round("utc", 3))


_add("t14_align_readings", _t14, "session seq utc reason",
     "SELECT r.session, seq, round(CASE WHEN a.clock IS NOT NULL AND r.clock >= a.clock AND (c2 IS NOT NULL OR r.clock - a.clock <= 60) THEN utc + (r.clock - a.clock) * CASE WHEN c2 IS NULL THEN 1 ELSE coalesce((u2 - utc) / nullif(c2 - a.clock, 0), 1) END END, 3) AS utc, CASE WHEN a.clock IS NULL THEN 'no_anchor' WHEN r.clock < a.clock THEN 'reset_before_sync' WHEN c2 IS NULL AND r.clock - a.clock > 60 THEN 'gap' END AS reason FROM rd r LEFT JOIN (SELECT *, lead(clock) OVER w AS c2, lead(utc) OVER w AS u2 FROM (SELECT session, sync, clock, clock * 1.0001 + 5 AS utc FROM rd WHERE n % 5 = 2) WINDOW w AS (PARTITION BY session ORDER BY sync)) a ON a.session = r.session AND a.sync = r.sync",
     ", rd AS (SELECT *, n // 5 AS sync FROM (SELECT user_id AS session, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1000000 AS clock FROM events))")


def _lines(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    label = F.when(F.col("event_type") == "click", "syncPinState").otherwise(F.col("event_type"))
    line = F.when(F.col("event_type") == "error", F.lit("garbled")).otherwise(F.concat_ws(", ", label, (F.col("event_id") % 2).cast("string"), (F.col("event_id") % 1000).cast("string")))
    return e.select(F.col("user_id").alias("session"), F.col("ts").alias("t"), F.col("event_id").alias("seq"), line.alias("value"))


MESSAGES = ", ms AS (SELECT user_id AS session, ts AS t, event_id AS seq, CASE event_type WHEN 'click' THEN 'sync' WHEN 'error' THEN 'unparsed' ELSE 'reading' END AS kind, CASE event_type WHEN 'click' THEN 'syncPinState' WHEN 'error' THEN NULL ELSE event_type END AS label, CASE WHEN event_type <> 'error' THEN (event_id % 2)::DOUBLE END AS number, CASE WHEN event_type <> 'error' THEN event_id % 1000 END AS interval FROM events)"
_add("t15_serial_messages", lambda s, d: tg.serial_messages(_lines(s, d)), "session seq kind label number interval", "SELECT * FROM ms", MESSAGES)
_add("t15_sync_transitions", lambda s, d: tg.sync_transitions(tg.serial_messages(_lines(s, d))), "session seq number", "SELECT session, seq, number FROM (SELECT *, lag(number) OVER (PARTITION BY session ORDER BY t, seq) AS p FROM ms WHERE kind = 'sync') WHERE p IS NULL OR p <> number", MESSAGES)

# Intervals and phases.
_add("j09_subtract", lambda s, d: po.subtract_windows(_spans(s, d).where("id % 2 = 0"), _spans(s, d).where("id % 2 = 1")), "session start stop",
     "SELECT session, min(a) AS start, max(b) AS stop FROM (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY a) AS g FROM (SELECT *, (lag(b) OVER (PARTITION BY session ORDER BY a) IS DISTINCT FROM a)::INT AS nw FROM (SELECT session, a, b FROM (SELECT session, t AS a, lead(t) OVER (PARTITION BY session ORDER BY t) AS b FROM (SELECT session, start AS t FROM ss UNION SELECT session, stop FROM ss)) e WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM ss w WHERE w.session = e.session AND id % 2 = 0 AND w.start <= a AND w.stop >= b) AND NOT EXISTS (SELECT 1 FROM ss w WHERE w.session = e.session AND id % 2 = 1 AND w.start <= a AND w.stop >= b)))) GROUP BY session, g", SPANS)
_add("j09_points_inside", lambda s, d: po.points_inside(_points(s, d).where("seq % 2 = 0"), _spans(s, d).where("id % 5 = 1"), 24 * HOUR), "session seq", "SELECT session, seq FROM pt WHERE seq % 2 = 0 AND EXISTS (SELECT 1 FROM ss w WHERE w.session = pt.session AND id % 5 = 1 AND w.start <= t AND w.stop > t)", SPANS)
_add("j10_on_off_pairs", lambda s, d: po.on_off_pairs(_points(s, d).withColumnRenamed("unit", "event"), "view", "click"), "session start stop", "SELECT session, t AS start, nt AS stop FROM (SELECT *, lead(t) OVER w AS nt, lead(unit) OVER w AS nu FROM pt WHERE unit IN ('view', 'click') WINDOW w AS (PARTITION BY session ORDER BY t, seq)) WHERE unit = 'view' AND nu = 'click'", MICRO_SQL)
_add("j10_clipped_contexts", lambda s, d: po.clip_windows(al.context_intervals(_points(s, d).where("unit = 'signup'")).select("session", "start", "stop"), _points(s, d).groupBy("session").agg(F.min("t").alias("low"), F.max("t").alias("high"))), "session start stop",
     "SELECT session, t AS start, coalesce(nt, hi) AS stop FROM (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t, seq) AS nt FROM pt WHERE unit = 'signup') JOIN (SELECT session, max(t) AS hi FROM pt GROUP BY 1) USING (session) WHERE coalesce(nt, hi) > t", MICRO_SQL)
_add("j04_bounded_map", lambda s, d: po.bounded_map(_points(s, d).withColumn("t", F.col("t") / 1e6), _seconds(s, d).where("seq % 4 = 0").select("session", F.col("t").alias("x"), (F.col("t") * 2).alias("y")), "null"), "session seq ~mapped",
     "SELECT session, seq, CASE WHEN t / 1e6 BETWEEN lo AND hi THEN CASE WHEN lo = hi THEN 2 * lo ELSE 2 * t / 1e6 END END AS mapped FROM pt JOIN (SELECT session, min(t) AS lo, max(t) AS hi FROM (SELECT session, t / 1e6 AS t, min(seq) AS seq FROM pt GROUP BY 1, 2) WHERE seq % 4 = 0 GROUP BY 1) USING (session)", MICRO_SQL)


def _phased(s: SparkSession, d: str) -> DataFrame:
    """Events with the phase of the day they stand at."""
    return _points(s, d).withColumn("phase", F.col("t") % (24 * HOUR) / (24 * HOUR) * po.TAU)


PHASED = MICRO_SQL + f", ph AS (SELECT *, (t % {24 * HOUR}) / {24 * HOUR} * {po.TAU} AS phase, t // {24 * HOUR} AS day FROM pt)"
_add("p03_phase_rates", lambda s, d: po.phase_rates(_phased(s, d), _phased(s, d), "unit", "phase", 60.0), "unit bin n ~occupancy ~rate ~relative enough",
     f"SELECT unit, bin, n, o * 60.0 AS occupancy, n / nullif(o * 60.0, 0) AS rate, n / nullif(o * 60.0, 0) / (sum(n) OVER (PARTITION BY unit) / (sum(o) OVER (PARTITION BY unit) * 60.0)) AS relative, sum(n) OVER (PARTITION BY unit) >= 50 AS enough FROM (SELECT unit, bin, count(*) FILTER (WHERE ph.unit = u.unit) AS n, count(seq) AS o FROM (SELECT DISTINCT unit FROM pt) u CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS bin) LEFT JOIN (SELECT unit AS unit2, seq, CAST(least(floor(phase / {po.TAU} * 12), 11) AS INTEGER) AS bin FROM ph) ph USING (bin) GROUP BY 1, 2)".replace("ph.unit = u.unit", "unit2 = unit"), PHASED)


def _by_day(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The consistency of each unit over all days, and of single days as draws."""
    rows = _phased(s, d).withColumn("day", F.floor(F.col("t") / (24 * HOUR)))
    whole = al.phase_locking(rows, ["unit"], "phase").withColumn("trials", F.lit(2))
    return whole, al.phase_locking(rows, ["unit", "day"], "phase")


PPC = "(c * c + s * s - n) / nullif(n * (n - 1), 0)"
NULLS = PHASED + f", ob AS (SELECT unit, n, {PPC} AS ppc FROM (SELECT unit, count(*) AS n, sum(cos(phase)) AS c, sum(sin(phase)) AS s FROM ph GROUP BY 1)), nl AS (SELECT unit, day, {PPC} AS ppc FROM (SELECT unit, day, count(*) AS n, sum(cos(phase)) AS c, sum(sin(phase)) AS s FROM ph GROUP BY 1, 2)), pp AS (SELECT unit, count(nl.ppc) AS draws, count(*) FILTER (WHERE nl.ppc >= ob.ppc) AS ov, avg(nl.ppc) AS null_mean, any_value(n) >= 50 AND count(nl.ppc) > 0 AS eligible FROM ob JOIN nl USING (unit) GROUP BY 1)"
_add("p05_permutation_p", lambda s, d: po.permutation_p(*_by_day(s, d), ["unit"]), "unit draws ~null_mean eligible ~p", "SELECT *, CASE WHEN eligible THEN (1 + ov) / (1 + draws) END AS p FROM pp", NULLS)
_add("p05_prevalence", lambda s, d: po.prevalence(al.adjust_bh(po.permutation_p(*_by_day(s, d), ["unit"]).withColumn("family", F.lit(1)), "family", "p", "unit"), ["family"]), "n_eligible n_significant ~prevalence",
     "SELECT count(*) FILTER (WHERE eligible) AS n_eligible, count(*) FILTER (WHERE eligible AND q < 0.05) AS n_significant, count(*) FILTER (WHERE eligible AND q < 0.05) / nullif(count(*) FILTER (WHERE eligible), 0) AS prevalence FROM (SELECT *, min(least(p * m / r, 1)) OVER (ORDER BY r DESC) AS q FROM (SELECT *, (1 + ov) / (1 + draws) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY (1 + ov) / (1 + draws), unit) AS r FROM pp))", NULLS)


def _bands(s: SparkSession, d: str) -> DataFrame:
    rows = _phased(s, d).withColumn("f", (F.floor(F.col("t") / (24 * HOUR)) % 6).cast("int"))
    return al.phase_locking(rows, ["unit", "f"], "phase", reliable=5)


BANDS = PHASED + f", bd AS (SELECT unit, f, n >= 5 AS reliable, {PPC} AS ppc FROM (SELECT unit, CAST(day % 6 AS INTEGER) AS f, count(*) AS n, sum(cos(phase)) AS c, sum(sin(phase)) AS s FROM ph GROUP BY 1, 2))"
_add("p06_unit_order", lambda s, d: po.unit_order(_bands(s, d), 1, 3), "unit ~mean_ppc place", "SELECT *, row_number() OVER (ORDER BY mean_ppc DESC NULLS LAST, unit) AS place FROM (SELECT unit, avg(ppc) FILTER (WHERE f BETWEEN 1 AND 3) AS mean_ppc FROM bd GROUP BY 1)", BANDS)
_add("p06_population_median", lambda s, d: po.population_median(_bands(s, d), ["f"]), "f n ~median_ppc", "SELECT f, count(ppc) FILTER (WHERE reliable) AS n, quantile_cont(ppc, 0.5) FILTER (WHERE reliable) AS median_ppc FROM bd GROUP BY 1", BANDS)


def _shuffled(s: SparkSession, d: str) -> DataFrame:
    """Consistency of each unit's hours with the phases of other days: spikes and phases by session (user) and day."""
    rows = _points(s, d).withColumn("trial", F.floor(F.col("t") / (24 * HOUR))).withColumn("i", F.floor(F.col("t") % (24 * HOUR) / HOUR))
    phases = rows.select("session", "trial").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("phase", (F.col("i") * 7 + F.col("trial")) % 24 * (po.TAU / 24))
    observed, null = po.shuffle_null(rows.select("session", "trial", "unit", "i"), phases, 20)
    return po.permutation_p(observed, null, ["session", "unit"], 5)


_add("p04_shuffle_null", lambda s, d: _shuffled(s, d), "session unit n trials ~ppc eligible",
     f"SELECT session, unit, n, trials, {PPC} AS ppc, n >= 5 AND trials >= 2 AND coalesce(days > 1, false) AS eligible FROM (SELECT session, unit, count(*) AS n, count(DISTINCT day) AS trials, sum(cos(x)) AS c, sum(sin(x)) AS s FROM (SELECT *, (h * 7 + day) % 24 * {po.TAU / 24} AS x FROM (SELECT *, (t % {24 * HOUR}) // {HOUR} AS h FROM ph)) GROUP BY 1, 2) JOIN (SELECT session, count(DISTINCT day) AS days FROM ph GROUP BY 1) USING (session)", PHASED)

# Signals: revenue by day, made dense, and the same of two kinds of orders as two sites.


def _dense(s: SparkSession, d: str, status: str | None = None) -> DataFrame:
    """Orders a day of all, or of one status, in series of 128 days: (series, i, v), 0 where there are none."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = table(s, d, "orders").select(day.alias("day"), "o_orderstatus", "o_totalprice")
    span = rows.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("a", F.explode(F.sequence("a", "b")).alias("day"))
    n = (rows if status is None else rows.where(F.col("o_orderstatus") == status)).groupBy("day").agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select(F.floor((F.col("day") - F.col("a")) / 128).alias("series"), ((F.col("day") - F.col("a")) % 128).cast("bigint").alias("i"), F.coalesce("n", F.lit(0)).cast("double").alias("v"))


def _dense_sql(name: str, where: str = "true") -> str:
    return f", {name} AS (SELECT (day - a) // 128 AS series, (day - a) % 128 AS i, coalesce(n, 0)::DOUBLE AS v FROM (SELECT unnest(range(min(x), max(x) + 1)) AS day, min(x) AS a FROM (SELECT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS x FROM orders)) LEFT JOIN (SELECT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, count(*) AS n FROM orders WHERE {where} GROUP BY 1) USING (day))"


DENSE = _dense_sql("dn")
TWO = _dense_sql("da", "o_orderstatus = 'F'") + _dense_sql("db", "o_orderstatus = 'O'")
_add("g05_running_median", lambda s, d: sp.running_median(_dense(s, d)), "series i ~median",
     "SELECT a.series, a.i, quantile_cont(b.v, 0.5) AS median FROM dn a JOIN (SELECT series, max(i) AS m FROM dn GROUP BY 1) USING (series) CROSS JOIN (SELECT unnest(range(-3, 4)) AS k) JOIN dn b ON b.series = a.series AND b.i = greatest(0, least(m, a.i + k)) GROUP BY 1, 2", DENSE)
_add("g07_speed", lambda s, d: sp.voltage_to_speed(_dense(s, d), 0.5, 1.5), "series i ~speed", "SELECT series, i, (v - 1.5) * 0.5 AS speed FROM dn", DENSE)
_add("g08_trial_traces", lambda s, d: sp.trial_traces(_dense(s, d), _dense(s, d).where("i % 20 = 5").select("series", F.col("i").alias("ref"), F.col("i").cast("double").alias("t0")), -3.0, 6.0, 0.5, 1.0), "series ref k ~v",
     "SELECT c.series, c.i AS ref, k, CASE WHEN w = 0 THEN a.v ELSE a.v * (1 - w) + b.v * w END AS v FROM (SELECT series, i, CAST(k AS INTEGER) AS k, floor(i - 3 + k * 0.5) AS x, (i - 3 + k * 0.5) - floor(i - 3 + k * 0.5) AS w FROM dn CROSS JOIN (SELECT unnest(range(18)) AS k) WHERE i % 20 = 5) c LEFT JOIN dn a ON a.series = c.series AND a.i = x LEFT JOIN dn b ON b.series = c.series AND b.i = x + 1", DENSE)
_add("g08_trace_quality", lambda s, d: sp.trace_quality(_dense(s, d).withColumn("ref", F.floor(F.col("i") / 16))), "series ref ~rms ~peak_to_peak reason",
     "SELECT series, i // 16 AS ref, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS peak_to_peak, CASE WHEN max(v) = min(v) THEN 'constant' END AS reason FROM dn GROUP BY 1, 2", DENSE)


def _kernel_sql(kernel: list[float]) -> str:
    half = len(kernel) // 2
    return "(SELECT * FROM (VALUES " + ", ".join(f"({k - half}, {v!r}::DOUBLE)" for k, v in enumerate(kernel)) + ") k(k, w))"


LOW, BAND, NOTCH = sp.sinc_kernel(6, 0.1), sp.bandpass_kernel(6, 0.05, 0.2), sp.notch_kernel(6, 0.25, 0.1)
_add("g12_filters", lambda s, d: sp.convolve(_dense(s, d), {"low": LOW, "band": BAND, "notch": NOTCH}, chunk=50), "series i ~low ~band ~notch",
     "SELECT series, i, " + ", ".join(f"(SELECT coalesce(sum(b.v * w), 0) FROM {_kernel_sql(k.tolist())} JOIN dn b ON b.series = a.series AND b.i = a.i + k) AS {n}" for n, k in (("low", LOW), ("band", BAND), ("notch", NOTCH))) + " FROM dn a", DENSE)
MORLET = sp.morlet_kernel(0.2, 1.0, 3.0)
_add("g13_wavelets", lambda s, d: sp.wavelets(_dense(s, d), [0.2], 1.0, 3.0, chunk=50), "series i ~re ~im ~power ~cr ~ci",
     f"SELECT *, CASE WHEN z >= 1e-12 THEN 2 * log10(z) END AS power, CASE WHEN z >= 1e-12 AND i >= {len(MORLET) // 2} AND i + {len(MORLET) // 2} <= m THEN re / z END AS cr, CASE WHEN z >= 1e-12 AND i >= {len(MORLET) // 2} AND i + {len(MORLET) // 2} <= m THEN im / z END AS ci FROM (SELECT *, sqrt(re * re + im * im) AS z, max(i) OVER (PARTITION BY series) AS m FROM (SELECT a.series, a.i, coalesce(sum(b.v * r.w), 0) AS re, coalesce(sum(b.v * j.w), 0) AS im FROM dn a CROSS JOIN {_kernel_sql(MORLET.real.tolist())} r JOIN {_kernel_sql((-MORLET.imag).tolist())} j ON j.k = r.k LEFT JOIN dn b ON b.series = a.series AND b.i = a.i + r.k GROUP BY 1, 2))", DENSE)
_add("g10_coherence", lambda s, d: sp.coherence(_dense(s, d, "F"), _dense(s, d, "O"), 1.0, 32), "series f segments ~frequency ~coherence",
     "SELECT series, f, segments, f / 32 AS frequency, least((xr * xr + xi * xi) / nullif(xx * yy, 0), 1) AS coherence FROM (SELECT series, CAST(f AS INTEGER) AS f, count(*) AS segments, sum(a.re * a.re + a.im * a.im) AS xx, sum(b.re * b.re + b.im * b.im) AS yy, sum(a.re * b.re + a.im * b.im) AS xr, sum(a.im * b.re - a.re * b.im) AS xi FROM fa a JOIN fb b USING (series, s, f) GROUP BY 1, 2)",
     TWO + "".join(f""", g{x} AS (SELECT series, i, v, s, i - s * 16 AS k FROM (SELECT *, unnest([i // 16, i // 16 - 1]) AS s, max(i) OVER (PARTITION BY series) AS m FROM d{x}) WHERE s >= 0 AND s * 16 + 31 <= m),
w{x} AS (SELECT *, (v - avg(v) OVER (PARTITION BY series, s)) * (0.5 - 0.5 * cos(2 * pi() * k / 32)) AS x FROM g{x}),
f{x} AS (SELECT series, s, f, sum(x * cos(2 * pi() * k * f / 32)) AS re, sum(x * -sin(2 * pi() * k * f / 32)) AS im FROM w{x} CROSS JOIN (SELECT unnest(range(17)) AS f) GROUP BY 1, 2, 3)""" for x in "ab"))  # fmt: skip


def _coefficients(s: SparkSession, d: str, status: str) -> DataFrame:
    """Coefficients made of the counts of one status: (trial, f, i, re, im)."""
    return _dense(s, d, status).select(F.col("series").alias("trial"), F.lit(1.0).alias("f"), "i", F.cos(F.col("v") + F.col("i")).alias("re"), F.sin(F.col("v") + F.col("i")).alias("im"))


def _relative(s: SparkSession, d: str) -> DataFrame:
    return sp.relative_phase(_coefficients(s, d, "F").withColumn("re", F.col("re") * 2).withColumn("im", F.col("im") * 2), _coefficients(s, d, "O"))


RELATIVE = TWO + ", rp AS (SELECT a.series AS trial, a.i, atan2(sin(a.v - b.v), cos(a.v - b.v)) AS phase FROM da a JOIN db b ON a.series = b.series AND a.i = b.i)"
_add("g19_relative_phase", lambda s, d: _relative(s, d).withColumn("c", F.cos("phase")), "trial i ~c ~amplitude_a ~amplitude_b", "SELECT trial, i, cos(phase) AS c, 2.0 AS amplitude_a, 1.0 AS amplitude_b FROM rp", RELATIVE)
_add("g15_trial_plv", lambda s, d: sp.trial_plv(_relative(s, d).withColumn("phase", F.when(F.col("i") % 9 != 4, F.col("phase"))), ["trial", "f"]), "trial n valid ~plv ~ppc",
     "SELECT trial, n, m AS valid, sqrt(c * c + s * s) / m AS plv, (c * c + s * s - m) / (m * (m - 1)) AS ppc FROM (SELECT trial, count(*) AS n, count(*) FILTER (WHERE i % 9 <> 4) AS m, sum(cos(phase)) FILTER (WHERE i % 9 <> 4) AS c, sum(sin(phase)) FILTER (WHERE i % 9 <> 4) AS s FROM rp GROUP BY 1)", RELATIVE)
_add("g14_site_coherence", lambda s, d: sp.site_coherence(*[_coefficients(s, d, k).withColumnsRenamed({"re": "cr", "im": "ci"}) for k in ("F", "O")]), "i n ~ispc", "SELECT i, count(*) AS n, sqrt(avg(cos(phase)) ^ 2 + avg(sin(phase)) ^ 2) AS ispc FROM rp GROUP BY 1", RELATIVE)
QUERIES["g06_extract_pulses"] = lambda s, d: sp.extract_pulses(_dense(s, d), 5, 2, 2)
QUERIES["g17_bootstrap_mean"] = lambda s, d: sp.bootstrap_mean(table(s, d, "events"), ["event_type"], "value", "event_id")
QUERIES["g18_lowess"] = lambda s, d: sp.lowess(_dense(s, d), 15, 2)
QUERIES["g02_debounce"] = lambda s, d: sp.debounce(_points(s, d).select(F.col("session").alias("line"), (F.col("t") / 1e6).alias("t"), (F.col("seq") % 2).cast("int").alias("state")), 3600.0)


def _coded(s: SparkSession, d: str) -> DataFrame:
    """The pulses of a time-code frame for noon thirty years after each day with orders, and of the marker before it: (line, t, width)."""
    day = F.col("o_orderdate").cast("date")
    days = table(s, d, "orders").select(day.alias("day")).distinct().withColumn("line", F.unix_date("day")).withColumn("day", F.add_months("day", 360))  # the code has two digits of the year
    digit = lambda n, v: (F.floor(n / 10 ** (len(str(v)) - 1)) % 10).cast("int").bitwiseAND(int(str(v)[0])) > 0  # noqa: E731  whether the decimal digit of n that v weighs has v's bit
    set_ = lambda n, bits: sum((((F.col("k") == k) & digit(n, v)).cast("int") for k, v in bits.items()), F.lit(0))
    rows = days.withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(59))))
    one = set_(F.lit(0), sp.MINUTES) + set_(F.lit(12), sp.HOURS) + set_(F.dayofyear("day"), sp.DAYS) + set_(F.year("day") % 100, sp.YEARS)
    width = F.when(F.col("k").isin(-1, *sp.MARKERS), 0.8).when(one > 0, 0.5).otherwise(0.2)
    return rows.select("line", F.col("k").cast("double").alias("t"), width.alias("width"))


_add("g03_time_code_frames", lambda s, d: sp.time_code_frames(sp.pulse_classes(_coded(s, d))), "line ~t utc", "SELECT DISTINCT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS line, 0.0::DOUBLE AS t, (CAST(CAST(o_orderdate AS DATE) + INTERVAL 360 MONTH AS DATE) - DATE '1970-01-01') * 86400 + 12 * 3600 AS utc FROM orders")
_add("g03_pulse_times", lambda s, d: sp.pulse_times(_coded(s, d), sp.time_code_frames(sp.pulse_classes(_coded(s, d)))), "line ~t utc",
     "SELECT line, k::DOUBLE AS t, CASE WHEN k >= 0 THEN later * 86400 + 12 * 3600 + k END AS utc FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS line, CAST(CAST(o_orderdate AS DATE) + INTERVAL 360 MONTH AS DATE) - DATE '1970-01-01' AS later FROM orders) CROSS JOIN (SELECT unnest(range(-1, 60)) AS k)")


def _flips(s: SparkSession, d: str) -> DataFrame:
    """The transitions of a barcode of each customer's key: (line, t, state)."""
    line = F.col("c_custkey")
    rows = table(s, d, "customer").select(line.alias("line"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    bits = rows.select("line", (F.lit(0.08) + F.col("k") * 0.03 - 0.01).alias("t"), (F.floor(F.col("line") / F.pow(F.lit(2.0), 31 - F.col("k"))) % 2).cast("int").alias("state"))
    head = table(s, d, "customer").select(line.alias("line"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("line", (F.col("k") * 0.01).alias("t"), (1 - F.col("k") % 2).cast("int").alias("state"))
    return head.unionByName(bits)


_add("g04_barcodes", lambda s, d: sp.barcodes(_flips(s, d)), "line ~t code", "SELECT c_custkey AS line, 0.0 AS t, c_custkey AS code FROM customer")

# Vectors and decoders.
FIRST, SECOND = list(range(32)), list(range(32, 64))  # the two regions of FIXTURES.md


def _units(s: SparkSession, d: str) -> DataFrame:
    return ve.long_form(table(s, d, "embeddings"), "vec_id", "embedding")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Vectors with fold and a label: 1 for even labels."""
    return _folded(s, d).select("vec_id", F.col("fold").cast("int").alias("fold"), F.col("embedding").cast("array<double>").alias("x"), (1 - F.col("label") % 2).cast("int").alias("label"), F.col("label").cast("string").alias("condition"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    """Counts y of one element of a vector, with all others as x."""
    return _folded(s, d).select(F.col("fold").cast("int").alias("fold"), F.floor(F.abs(F.get("embedding", F.lit(0))) * 10).cast("double").alias("y"), F.slice(F.col("embedding").cast("array<double>"), 2, 63).alias("x"))


_add("m01_standardise", lambda s, d: dc.standardise(table(s, d, "embeddings"), ve.scaling(_units(s, d)), "embedding", "vec_id"), "vec_id unit ~z", "SELECT vec_id, unit, (x - m) / s AS z FROM lv JOIN (SELECT unit, avg(x) AS m, stddev_pop(x) AS s FROM lv GROUP BY 1 HAVING stddev_pop(x) > 0) USING (unit)", LONG)
QUERIES["m02_ridge_regions"] = lambda s, d: li.ridge(_folded(s, d), "embedding", FIRST, SECOND, 0.01)
_add("m02_normal_equations", lambda s, d: dc.normal_equations(table(s, d, "embeddings"), li.ridge(table(s, d, "embeddings"), "embedding", FIRST, SECOND), "embedding", FIRST, SECOND, "vec_id"), "response term ~moment",
     "SELECT CAST(r AS INTEGER) AS response, CAST(t AS INTEGER) AS term, 0.0 AS moment FROM (SELECT unnest(range(32, 64)) AS r) CROSS JOIN (SELECT unnest(range(-1, 32)) AS t)")


def _component_products(s: SparkSession, d: str) -> DataFrame:
    z = dc.standardise(table(s, d, "embeddings"), ve.scaling(_units(s, d)), "embedding", "vec_id")
    scores = dc.component_scores(z, li.pca(table(s, d, "embeddings"), "embedding"), "vec_id")
    wide = scores.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("component", "score"))), lambda v: v["score"]).alias("v"))
    each = wide.select("v", F.posexplode("v").alias("i", "a")).select("i", "a", F.posexplode("v").alias("j", "b")).where("i < j")
    return each.groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("product"))


_add("m07_score_products", _component_products, "i j ~product", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0.0 AS product FROM (SELECT unnest(range(64)) AS i) CROSS JOIN (SELECT unnest(range(64)) AS j) WHERE i < j")
QUERIES["m07_components_to_reach"] = lambda s, d: dc.components_to_reach(li.pca(table(s, d, "embeddings"), "embedding"))


def _axis_products(s: SparkSession, d: str) -> DataFrame:
    """Means of products of scores (u then v, from 0) less what the axes state: 1 with itself, the correlation with its pair, else 0."""
    rows = table(s, d, "embeddings")
    axes = li.cca_axes(rows, "embedding", FIRST, SECOND)
    each = li.cca_transform(rows, axes, "embedding", FIRST, SECOND).select(F.concat("u", "v").alias("z"))
    pairs = each.select("z", F.posexplode("z").alias("i", "a")).select("i", "a", F.posexplode("z").alias("j", "b")).where("i <= j").groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("m"))
    stated = F.when(F.col("i") == F.col("j"), 1.0).when(F.col("j") == F.col("i") + len(FIRST), F.col("correlation")).otherwise(0.0)
    return pairs.join(F.broadcast(axes.select("component", "correlation")), F.col("component") == F.col("i") + 1, "left").select("i", "j", (F.col("m") - stated).alias("product"))


_add("m09_axis_products", _axis_products, "i j ~product", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0.0 AS product FROM (SELECT unnest(range(64)) AS i) CROSS JOIN (SELECT unnest(range(64)) AS j) WHERE i <= j")
QUERIES["m09_cca_regions"] = lambda s, d: li.cca(table(s, d, "embeddings"), "embedding", FIRST, SECOND)
_add("m08_window_variance", lambda s, d: dc.window_variance(_units(s, d).where("unit <= 12").withColumnsRenamed({"unit": "component", "x": "score"}).withColumn("win", F.col("vec_id") % 7), ["win"]), "win component n ~variance ~fraction place ~cumulative n_to_share status",
     "SELECT *, min(place) FILTER (WHERE cumulative >= 0.8 - 1e-12) OVER (PARTITION BY win) AS n_to_share, 'ok' AS status FROM (SELECT *, sum(fraction) OVER (PARTITION BY win ORDER BY place) AS cumulative FROM (SELECT *, variance / sum(variance) OVER (PARTITION BY win) AS fraction, row_number() OVER (PARTITION BY win ORDER BY variance DESC, component) AS place FROM (SELECT vec_id % 7 AS win, unit AS component, count(*) AS n, var_samp(x) AS variance FROM lv WHERE unit <= 12 GROUP BY 1, 2)))", LONG)
_add("m18_similarity_matrix", lambda s, d: dc.similarity_matrix(ve.condition_means(ve.long_form(table(s, d, "embeddings"), "vec_id", "embedding", "label"), "label"), "label"), "a b ~r n", "SELECT p.label AS a, q.label AS b, corr(p.mean, q.mean) AS r, count(*) AS n FROM cm p JOIN cm q USING (unit) WHERE p.label < q.label GROUP BY 1, 2", LONG)


def _rsa(s: SparkSession, d: str) -> DataFrame:
    means = ve.condition_means(ve.long_form(table(s, d, "embeddings"), "vec_id", "embedding", "label"), "label")
    return dc.rsa(dc.similarity_matrix(means.where("unit <= 32"), "label"), dc.similarity_matrix(means.where("unit > 32"), "label"))


_add("m18_rsa", _rsa, "~rsa n", "SELECT corr(x, y) AS rsa, count(*) AS n FROM (SELECT corr(p.mean, q.mean) FILTER (WHERE unit <= 32) AS x, corr(p.mean, q.mean) FILTER (WHERE unit > 32) AS y FROM cm p JOIN cm q USING (unit) WHERE p.label < q.label GROUP BY p.label, q.label)", LONG)
_add("m15_scored", lambda s, d: dc.scored(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("lang", F.col("quality").alias("label"), (F.col("n_chars") / (F.col("n_chars") + 1500)).alias("p")), "lang"), "lang n tp fp fn tn ~log_loss ~average_precision",
     "SELECT * FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS log_loss FROM lp GROUP BY 1) JOIN (SELECT lang, sum(k / nullif(tot, 0) * pre) AS average_precision FROM (SELECT *, sum(k) OVER (PARTITION BY lang) AS tot, sum(k) OVER w / sum(m) OVER w AS pre FROM (SELECT lang, p, sum(y) AS k, count(*) AS m FROM lp GROUP BY 1, 2) WINDOW w AS (PARTITION BY lang ORDER BY p DESC)) GROUP BY 1) USING (lang)",
     ", lp AS (SELECT lang, quality AS y, n_chars / (n_chars + 1500) AS p FROM labels JOIN documents USING (doc_id))")
_add("m24_session_table", lambda s, d: dc.session_table(table(s, d, "events").select(F.col("user_id").alias("session"), F.lit(1).alias("date"), "event_type", "value"), "session", "date", "event_type", "value"), "session number ~click ~view", "SELECT user_id AS session, row_number() OVER (ORDER BY user_id) AS number, avg(value) FILTER (WHERE event_type = 'click') AS click, avg(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
QUERIES["m04_penalised_paths"] = lambda s, d: dc.penalised_paths(dc.side_design(su.blocks(trials(s, d))).withColumn("fold", (F.col("block_run") % 5).cast("int")))
QUERIES["m05_poisson"] = lambda s, d: dc.poisson(_counts(s, d))
QUERIES["m10_reduced_rank"] = lambda s, d: dc.reduced_rank(_folded(s, d), "embedding", "fold", FIRST, SECOND)
QUERIES["m10_nested_rank"] = lambda s, d: dc.nested_rank(_folded(s, d), "embedding", "fold", FIRST, SECOND)
QUERIES["m11_decode"] = lambda s, d: dc.decode(_labelled(s, d)).select("vec_id", "fold", "label", "p", "reason")
QUERIES["m11_tuned"] = lambda s, d: dc.tuned(_labelled(s, d))
QUERIES["m11_tuned_bins"] = lambda s, d: dc.tuned(_labelled(s, d).select("fold", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice("x", 16 * b + 1, 16))).alias("bin", "x")), cell="bin")
QUERIES["m12_decodability"] = lambda s, d: dc.decodability(_labelled(s, d), "vec_id", 20)


def _conditions(rows: DataFrame, models: list[ba.Model], family: str, size: int) -> DataFrame:
    """How far the fits of the models are from the conditions of an optimum."""
    return ba.violations(rows, ba.fit(rows, models, family), family, size)


def _type_counts(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts y of every type of event, in the order of the names, with two lags of each as x (lag 1 of all, then lag 2)."""
    e = table(s, d, "events").where("event_type IS NOT NULL").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR).alias("i"), "event_type").agg(F.count("*").cast("double").alias("n"))
    names = sorted(r[0] for r in e.select("event_type").distinct().collect())
    wide = e.groupBy("i").pivot("event_type", names).agg(F.first("n")).na.fill(0.0).select("i", F.array(*[F.col(f"`{n}`") for n in names]).alias("y"))
    for lag in (1, 2):
        wide = wide.join(wide.select((F.col("i") + lag).alias("i"), F.col("y").alias(f"y{lag}")), "i")
    return ba.laid(wide.withColumn("x", F.concat("y1", "y2")), F.col("y"), fold=None)


def _lags(s: SparkSession, d: str) -> tuple[DataFrame, int, list[list[int]], list[list[int]]]:
    """Rows, the number of types, and by type the columns of its own lags and of those of all others."""
    rows = _type_counts(s, d)
    n = len(rows.select("y").first()[0])
    return rows, n, [[r, n + r] for r in range(n)], [[c for c in range(2 * n) if c % n != r] for r in range(n)]


def _poisson_models(s: SparkSession, d: str) -> DataFrame:
    rows, n, own, other = _lags(s, d)
    return _conditions(rows, [ba.Model(r, columns=tuple(range(2 * n))) for r in range(n)], "poisson", 2 * n)


TERMS = "SELECT CAST(m AS INTEGER) AS model, CAST(t AS INTEGER) AS term, 0.0 AS violation FROM (SELECT unnest(range(0, {})) AS m) CROSS JOIN (SELECT unnest(range(-1, {})) AS t)"
QUERIES["m06_poisson_granger"] = lambda s, d: ba.poisson_granger(*_lags(s, d))
_add("m06_poisson_conditions", _poisson_models, "model term ~violation", TERMS.format("(SELECT count(DISTINCT event_type) FROM events)", "(SELECT 2 * count(DISTINCT event_type) FROM events)"))
_add("m05_poisson_conditions", lambda s, d: _conditions(ba.laid(_counts(s, d), F.array("y")), [ba.Model(fold=k) for k in range(5)], "poisson", 63), "model term ~violation", TERMS.format(5, 63))
_add("m11_conditions", lambda s, d: _conditions(ba.laid(_labelled(s, d), F.array("label")), [ba.Model(0, k, 0, None, p, e) for k in range(5) for p, e in dc.GRID], "logistic", 64), "model term ~violation", TERMS.format(75, 64))
PENALTIES = (0.1, 0.03, 0.01, 0.003, 0.001)


def _path_conditions(s: SparkSession, d: str) -> DataFrame:
    rows = _folded(s, d).select(F.get("embedding", F.lit(0)).cast("double").alias("y"), F.slice(F.col("embedding").cast("array<double>"), 2, 63).alias("x"))
    return dc.penalised_violations(rows, dc.penalised_weights(rows, PENALTIES, 0.5), 63, 0.5).withColumn("thousandths", F.round(F.col("penalty") * 1000).cast("int"))


_add("m04_path_conditions", _path_conditions, "thousandths term ~violation", "SELECT a AS thousandths, CAST(t AS INTEGER) AS term, 0.0 AS violation FROM (SELECT unnest([100, 30, 10, 3, 1]) AS a) CROSS JOIN (SELECT unnest(range(-1, 63)) AS t)")
QUERIES["m13_transfer"] = lambda s, d: dc.transfer(_labelled(s, d), F.col("fold") < 2, F.col("fold") > 2, "vec_id")
QUERIES["m14_readouts"] = lambda s, d: dc.readouts(_labelled(s, d), _labelled(s, d).select(F.col("vec_id").alias("window"), "fold", "x"))
QUERIES["m19_shattering"] = lambda s, d: dc.shattering(_labelled(s, d), ["0", "1", "2"], "vec_id")
QUERIES["m20_tree_importance"] = lambda s, d: dc.tree_importance(hi.regressors(trials(s, d)), ["relative_omissions", "persistence", "wsls", "hazard"], "action")


def _sequence(s: SparkSession, d: str) -> DataFrame:
    """Each user's values in order: (session, i, x, y)."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(s, d, "events").select(F.col("user_id").alias("session"), i.cast("bigint").alias("i"), F.array().cast("array<double>").alias("x"), F.coalesce("value", F.lit(0.0)).alias("y"))


def _smoothed(s: SparkSession, d: str) -> DataFrame:
    return hmm.smooth(_sequence(s, d).withColumn("ll", hmm.gaussian_levels("y", [10.0, 40.0], [15.0, 25.0])), hmm.sticky(2), chunk=16)


# Forward and backward chances by recursion, one trial at a time.
SMOOTH = """, ys AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, coalesce(value, 0) AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events),
em AS (SELECT *, exp(-0.5 * ((y - 10) / 15) ^ 2) / 15 AS e0, exp(-0.5 * ((y - 40) / 25) ^ 2) / 25 AS e1 FROM ys),
fw(session, i, a0, a1) AS (SELECT session, i, e0 / (e0 + e1), e1 / (e0 + e1) FROM em WHERE i = 0 UNION ALL SELECT session, i, u / (u + w), w / (u + w) FROM (SELECT m.session, m.i, (0.9 * a0 + 0.1 * a1) * e0 AS u, (0.1 * a0 + 0.9 * a1) * e1 AS w FROM fw JOIN em m ON m.session = fw.session AND m.i = fw.i + 1)),
bw(session, i, b0, b1) AS (SELECT session, i, 1.0::DOUBLE, 1.0::DOUBLE FROM em WHERE i = n - 1 UNION ALL SELECT session, i, u / (u + w), w / (u + w) FROM (SELECT m.session, m.i - 1 AS i, 0.9 * e0 * b0 + 0.1 * e1 * b1 AS u, 0.1 * e0 * b0 + 0.9 * e1 * b1 AS w FROM bw JOIN em m ON m.session = bw.session AND m.i = bw.i WHERE m.i > 0))"""
_add("m21_smooth", lambda s, d: _smoothed(s, d).withColumn("p1", F.get("posterior", F.lit(1))), "session i ~p1 state", "SELECT session, i, a1 * b1 / (a0 * b0 + a1 * b1) AS p1, (a1 * b1 > a0 * b0)::INT AS state FROM fw JOIN bw USING (session, i)", SMOOTH)
_add("m22_occupancy", lambda s, d: hmm.occupancy(_smoothed(s, d)), "session state n ~share", "SELECT session, state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY session) AS share FROM (SELECT session, (a1 * b1 > a0 * b0)::INT AS state FROM fw JOIN bw USING (session, i)) GROUP BY 1, 2", SMOOTH)


def _to_its_end(rows: DataFrame, states: int) -> hmm.Hmm:
    """A linear or Gaussian model fitted until a step of EM gains less than 1e-6 in all, the reference's rule and its limit of steps."""
    return hmm.fit(rows, states, steps=10_000, tolerance=1e-6 / max(rows.count(), 1), ahead=10)


def _fitted(s: SparkSession, d: str, logistic: bool = False) -> DataFrame:
    """States, weights and scores of a two-state model of each user's values (or of their switches)."""
    rows = _sequence(s, d)
    if logistic:
        rows = rows.withColumn("y", (F.col("y") >= 20).cast("double")).withColumn("x", F.array(F.sin(F.col("i").cast("double"))))
    else:
        rows = rows.withColumn("x", F.array((F.col("i") % 2).cast("double")))
    model = hmm.fit(rows, 2, True, steps=6) if logistic else _to_its_end(rows, 2)
    score = hmm.information(2, 1, model.loglik, rows.count())
    cells = [(k, [float(v) for v in w], None if model.deviations is None else float(model.deviations[k]), [float(v) for v in t], model.loglik, score["aic"], score["bic"]) for k, (w, t) in enumerate(zip(model.weights, model.transitions, strict=True))]
    return s.createDataFrame(cells, "state int, weights array<double>, deviation double, moves array<double>, loglik double, aic double, bic double")


QUERIES["m22_linear_hmm"] = lambda s, d: _fitted(s, d)
QUERIES["m22_logistic_hmm"] = lambda s, d: _fitted(s, d, True)
QUERIES["m23_gaussian_hmm"] = lambda s, d: s.createDataFrame([(k, float(w[0]), float(v)) for m in [_to_its_end(_sequence(s, d), 3)] for k, (w, v) in enumerate(zip(m.weights, m.deviations, strict=True))], "state int, mean double, deviation double")

def _by_parity(s: SparkSession, d: str) -> DataFrame:
    """Each user's values with whether their place is odd as the input."""
    return _sequence(s, d).withColumn("x", F.array((F.col("i") % 2).cast("double")))


def _one_state(s: SparkSession, d: str) -> DataFrame:
    """What one state comes to: least squares without each held-out stretch, and how likely the stretch is under it."""
    models = sc.sweep(_by_parity(s, d), [1], 5, steps=2, tolerance=0.0)
    cells = [(m.out, m.n, m.held_n, m.loglik / m.n, m.held_loglik / m.held_n if m.held_n else None, float(m.weights[0, 0]), float(m.weights[0, 1]), float(m.deviations[0])) for m in models]
    return s.createDataFrame(cells, "fold int, n bigint, held_n bigint, loglik double, held_out double, intercept double, slope double, deviation double")


# Stretches of each user's rows, the first n % 5 of them a row longer.
STRETCH = """, ys AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, coalesce(value, 0)::DOUBLE AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events),
sx AS (SELECT session, i, (i % 2)::DOUBLE AS x, y, CASE WHEN i < n % 5 * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - n % 5 * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM ys),
md AS (SELECT k.fold, s.fold = k.fold AS held, x, y FROM sx s CROSS JOIN (SELECT unnest(range(-1, 5)) AS fold) k),
lr AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sqrt(regr_syy(y, x) / count(*) * (1 - regr_r2(y, x))) AS sd FROM md WHERE NOT held GROUP BY 1)"""
_add("m22_stretches", lambda s, d: sc.lengths_of(_sequence(s, d), 5), "session fold first n", "SELECT session, fold, min(i) AS first, count(*) AS n FROM sx GROUP BY 1, 2", STRETCH)
_add("m22_one_state", _one_state, "fold n held_n ~loglik ~held_out ~intercept ~slope ~deviation",
     "SELECT fold, any_value(lr.n) AS n, count(*) FILTER (WHERE held) AS held_n, -ln(any_value(sd) * sqrt(2 * pi())) - avg(((y - a - b * x) / sd) ^ 2) FILTER (WHERE NOT held) / 2 AS loglik, -ln(any_value(sd) * sqrt(2 * pi())) - avg(((y - a - b * x) / sd) ^ 2) FILTER (WHERE held) / 2 AS held_out, any_value(a) AS intercept, any_value(b) AS slope, any_value(sd) AS deviation FROM md JOIN lr USING (fold) GROUP BY 1", STRETCH)
QUERIES["m22_state_choice"] = lambda s, d: sc.scores(s, sc.sweep(_by_parity(s, d), [1, 2, 3], 5, steps=30))


def _user_spectra(s: SparkSession, d: str) -> DataFrame:
    """Densities of each user's values, a user being a trial."""
    rows = _sequence(s, d).select("session", "i", F.col("y").alias("v"))
    return asm.welch(rows.withColumnRenamed("session", "series"), 1.0, 32)


def _levels(s: SparkSession, d: str) -> DataFrame:
    spectra = _user_spectra(s, d)
    return sp.spectrum_levels(spectra, sp.reference_spectrum(spectra))


BY_USER = WELCH.replace("event_type", "user_id") + """, rf AS (SELECT f, quantile_cont(density, 0.5) AS reference FROM psd GROUP BY 1),
db AS (SELECT series, f, reference, CASE WHEN density > 0 AND reference > 0 THEN 10 * log10(density / reference) END AS db FROM psd JOIN rf USING (f))"""
_add("g11_levels", _levels, "series f ~reference ~db", "SELECT series, f, reference, db FROM db", BY_USER)
_add("g11_level_quartiles", lambda s, d: sp.quartiles(_levels(s, d), ["f"], "db"), "f n ~median ~low ~high",
     "SELECT f, count(db) AS n, quantile_cont(db, 0.5) AS median, quantile_cont(db, 0.25) AS low, quantile_cont(db, 0.75) AS high FROM db WHERE db IS NOT NULL GROUP BY 1", BY_USER)

# The panel of policies; its SQL walks the history one trial at a time.
PANEL = SIDED + """, pw(session, rn, seq, same, paid, home, n, away, run, pooled, fq) AS (
  SELECT session, 0::BIGINT, NULL::BIGINT, 0, 0, -1, 0, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM v WHERE rn = 1
  UNION ALL SELECT session, rn, seq, same, paid, home, n, away, run, pooled, fq FROM (SELECT x.session, x.rn, x.seq, s.* EXCLUDE (session, rn) FROM v x JOIN (
    SELECT w.session, w.rn, CASE WHEN w.rn = 0 THEN 0 ELSE 2 * a - 1 END AS same, CASE WHEN w.rn = 0 THEN 0 ELSE r END AS paid, CASE WHEN r = 1 THEN a ELSE home END AS home,
      CASE WHEN r = 1 THEN CASE WHEN home = a THEN n + 1 ELSE 1 END WHEN home >= 0 AND a <> home THEN 0 ELSE n END AS n,
      CASE WHEN r = 1 OR home < 0 OR a = home THEN 0 ELSE away + 1 END AS away,
      CASE WHEN r = 1 THEN CASE WHEN home = a THEN run + 1 ELSE 1 END ELSE run END AS run,
      CASE WHEN w.rn = 0 THEN 0 ELSE 0.8 * pooled + r END AS pooled, CASE WHEN w.rn = 0 THEN 0 ELSE 0.7 * fq + 0.3 * r * (2 * a - 1) END AS fq
    FROM pw w LEFT JOIN (SELECT session, rn, action AS a, reward AS r FROM v) b ON b.session = w.session AND b.rn = w.rn) s ON x.session = s.session AND x.rn = s.rn + 1)),
pq AS (SELECT pw.*, -doubt_value AS d, -same * paid AS probe, (1 + tanh(run - 3)) / 2 AS s3, (1 + tanh((run - 2.5) / 0.5)) / 2 AS s25, (1 + tanh((pooled - 2) / 0.5)) / 2 AS sg FROM pw JOIN (SELECT session, seq, doubt_value FROM doubt) USING (session, seq) WHERE pw.rn > 0)"""


def _panel_sql() -> str:
    half = "(1 + tanh({})) / 2".format
    expected = lambda s: f"CASE WHEN same = 0 THEN 0.5 WHEN paid > 0 THEN CASE WHEN same < 0 THEN 0.1 + 0.8 * {s} ELSE 0.9 - 0.8 * {s} END ELSE {half('same + 1.4 * d')} END"
    goal = lambda n: f"CASE WHEN home < 0 THEN 0.5 WHEN (CASE WHEN away > 0 THEN CASE WHEN away < {n} THEN 1 - home ELSE home END WHEN paid > 0 AND n >= {n} THEN 1 - home ELSE home END) = 1 THEN 0.9 ELSE 0.1 END"
    found = {
        "chance": "0.5", "immediate_persistence": "(1 + same) / 2", "wsls": "(1 + CASE WHEN paid > 0 THEN same ELSE -same END) / 2", "win_switch_lose_stay": "(1 + CASE WHEN paid > 0 THEN -same ELSE same END) / 2",
        "simple_probe_persistence": half("same + probe"), "expectancy_persistence_doubt": half("same + probe * s3 + d"), "forgetting_q_learning": "1 / (1 + exp(-fq))", "probe_persistence_doubt": half("same + 2 * probe + 1.4 * d"),
        "direct_expectancy_switch_doubt": expected("s25"), "global_reward_expectancy_doubt": expected("sg"), "home_referenced_expectancy_doubt": half("CASE WHEN home < 0 THEN 0 ELSE (2 * home - 1) * (1 - 2 * s25) END + d"),
        "threshold_probe_return_3_3": goal(3), "threshold_probe_return_1_1": goal(1),
    }
    return " UNION ALL ".join(f"SELECT session, seq, '{n}' AS policy, ({x})::DOUBLE AS p_left FROM pq" for n, x in found.items())


_add("f06_policy_panel", lambda s, d: pl.policy_panel(trials(s, d)).where("policy != 'history_ideal_observer'"), "session seq policy ~p_left", _panel_sql(), PANEL)
QUERIES["f06_observer_panel"] = lambda s, d: pl.observer_panel(pl.policy_panel(trials(s, d)))


# Remaining operators of sessions and streams.
_add("x02_live_doubt", lambda s, d: live.run_to_end(live.live_doubt(_micros(trials_of(_stream(s, d)).where("valid")))), "session seq omissions_left omissions_right doubt_left doubt_right ~doubt_value", "SELECT * FROM doubt", SIDED)
_add("t10_context_order", lambda s, d: se.context_order(trials(s, d).where("seq % 3 = 0").select("session", "t", "seq", F.col("state").alias("side")), trials(s, d)), "session block_run logged state",
     "SELECT session, block_run, logged, state FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS block_run, state AS logged FROM trials WHERE seq % 3 = 0) FULL JOIN (SELECT session, block_run, min(state) AS state FROM runs GROUP BY 1, 2) USING (session, block_run) WHERE logged IS DISTINCT FROM state", RUNS)
_add("a33_stack_tables", lambda s, d: se.stack_tables({"left": trials(s, d).where("action = 1").select("session", "seq", "reward"), "right": trials(s, d).where("action = 0").select("session", "seq", "state")}), "session_ID session seq reward state",
     "SELECT 'left' AS session_ID, session, seq, reward, NULL AS state FROM trials WHERE action = 1 UNION ALL SELECT 'right', session, seq, NULL, state FROM trials WHERE action = 0")
_add("c12_residual_moments", lambda s, d: se.residualize_many(hi.regressors(trials(s, d)), "action", ["relative_omissions", "wsls", "hazard"]).agg(F.avg("residual").alias("m0"), F.avg(F.col("residual") * F.col("relative_omissions")).alias("m1"), F.avg(F.col("residual") * F.col("wsls")).alias("m2"), F.avg(F.col("residual") * F.col("hazard")).alias("m3"), F.count("residual").alias("n")),
     "~m0 ~m1 ~m2 ~m3 n", "SELECT 0.0 AS m0, 0.0 AS m1, 0.0 AS m2, 0.0 AS m3, count(*) AS n FROM v", VALID)
_add("s09_ordered_digest", lambda s, d: so.ordered_digest(trials(s, d), "session", ["t", "seq"], ["action", "reward", "state"]), "session n digest",
     "SELECT session, count(*) AS n, CAST(sum(('0x' || substr(sha256(concat(k, ';', coalesce(len(action::VARCHAR) || ':' || action, '-'), coalesce(len(reward::VARCHAR) || ':' || reward, '-'), coalesce(len(state::VARCHAR) || ':' || state, '-'))), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS k FROM trials) GROUP BY 1")
QUERIES["a11_regression_table"] = lambda s, d: se.regression_table(su.blocks(trials(s, d)))
QUERIES["j21_sample_rows"] = lambda s, d: se.sample_rows(table(s, d, "events"), 50, "event_id")
