"""The registered queries of the library's own operators, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import align as al
from weftline.operators import assembly as asm
from weftline.operators import decisions as de
from weftline.operators import features as fe
from weftline.operators import history as hi
from weftline.operators import linear as li
from weftline.operators import replays as rp
from weftline.operators import summaries as su
from weftline.operators import timeline as tl
from weftline.operators import vectors as ve
from weftline.operators.ranks import numbered
from weftline.plans.standins import TRIALS_SQL, table, trials, trials_of
from weftline.sources import tables as so
from weftline.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], columns: str, sql: str, ctes: str = "") -> None:
    """Registers run's columns; doubles in `columns` marked with ~ are rounded to 6 digits on both sides."""
    names = [c.lstrip("~") for c in columns.split()]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(*[(F.round(c[1:], 6) + F.lit(0.0)).alias(c[1:]) if c[0] == "~" else F.col(c) for c in columns.split()])

    QUERIES[name] = query
    picked = ", ".join(f"round({c[1:]}, 6) + 0.0 AS {c[1:]}" if c[0] == "~" else c for c in columns.split())
    SQL[name] = f"WITH RECURSIVE {TRIALS_SQL}{ctes} SELECT {picked} FROM ({sql})"
    assert len(set(names)) == len(names)


# Common table expressions of the SQL.
VALID = ", v AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS rn FROM trials WHERE valid)"
RUNS = """, r0 AS (SELECT *, CASE WHEN lag(block) OVER w IS DISTINCT FROM block OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM trials WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
runs AS (SELECT * EXCLUDE nw, sum(nw) OVER (PARTITION BY session ORDER BY t, seq) AS block_run FROM r0)"""
VRUNS = """, q0 AS (SELECT *, CASE WHEN lag(block) OVER w IS DISTINCT FROM block OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM trials WHERE valid WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
vruns AS (SELECT * EXCLUDE nw, sum(nw) OVER (PARTITION BY session ORDER BY t, seq) AS block_run FROM q0)"""
BLOCKS = RUNS + """, b0 AS (SELECT *, CASE WHEN valid THEN sum(valid::INT) OVER (PARTITION BY session, block_run ORDER BY t, seq) - 1 END AS pos FROM runs),
b1 AS (SELECT *, min(pos) FILTER (WHERE valid AND correct = 1) OVER (PARTITION BY session, block_run) AS ttc FROM b0),
b2 AS (SELECT session, block_run, min(state) AS state, count(*) AS n_trials, count(*) FILTER (WHERE valid) AS n_valid, min(ttc) AS trials_to_correct,
  avg(correct) FILTER (WHERE valid AND pos > ttc) AS accuracy_after, coalesce(sum(reward) FILTER (WHERE valid), 0) AS n_rewarded FROM b1 GROUP BY 1, 2),
blocks AS (SELECT *, coalesce(lag(n_rewarded) OVER w, 0) AS prev_n_rewarded, lag(n_trials) OVER w AS prev_n_trials FROM b2 WINDOW w AS (PARTITION BY session ORDER BY block_run))"""
COUNTERS = VALID + """, c0 AS (SELECT *, CASE WHEN lag(reward) OVER w IS DISTINCT FROM reward THEN 1 ELSE 0 END AS nw FROM v WINDOW w AS (PARTITION BY session ORDER BY rn)),
c1 AS (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY rn) AS orun FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY session, orun ORDER BY rn) AS n FROM c1),
counters AS (SELECT *, coalesce(lag(CASE WHEN reward = 1 THEN n ELSE 0 END) OVER w, 0) AS consecutive_rewards, coalesce(lag(CASE WHEN reward = 0 THEN n ELSE 0 END) OVER w, 0) AS consecutive_omissions,
  coalesce(last_value(CASE WHEN reward = 1 THEN n END IGNORE NULLS) OVER p, 0) AS renewal_rewards, coalesce(last_value(CASE WHEN reward = 0 THEN n END IGNORE NULLS) OVER p, 0) AS renewal_omissions,
  CAST(coalesce(sum(1 - 2 * reward) OVER p, 0) AS BIGINT) AS negative_value FROM c2
  WINDOW w AS (PARTITION BY session ORDER BY rn), p AS (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SIDED = VALID + """, s0 AS (SELECT *, coalesce(max(CASE WHEN action = 1 AND reward = 1 THEN rn END) OVER p, 0) AS l0, coalesce(max(CASE WHEN action = 0 AND reward = 1 THEN rn END) OVER p, 0) AS r0,
  coalesce(max(CASE WHEN reward = 1 THEN rn END) OVER p, 0) AS a0 FROM v WINDOW p AS (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sided AS (SELECT a.*, (SELECT count(*) FROM v b WHERE b.session = a.session AND b.rn < a.rn AND b.rn > a.l0 AND b.action = 1 AND b.reward = 0) AS omissions_left,
  (SELECT count(*) FROM v b WHERE b.session = a.session AND b.rn < a.rn AND b.rn > a.r0 AND b.action = 0 AND b.reward = 0) AS omissions_right,
  (SELECT count(*) FROM v b WHERE b.session = a.session AND b.rn < a.rn AND b.rn > a.a0 AND b.action = 1 AND b.reward = 0) AS doubt_left,
  (SELECT count(*) FROM v b WHERE b.session = a.session AND b.rn < a.rn AND b.rn > a.a0 AND b.action = 0 AND b.reward = 0) AS doubt_right FROM s0 a),
doubt AS (SELECT *, (1 - exp(-0.5 * doubt_left)) - (1 - exp(-0.5 * doubt_right)) AS doubt_value FROM sided),
greedy AS (SELECT *, coalesce(last_value(CASE WHEN doubt_value > 0 THEN 1 WHEN doubt_value < 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS greedy FROM doubt)"""
EPISODES = VALID + """, e0 AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS nw FROM v WINDOW w AS (PARTITION BY session ORDER BY rn)),
e1 AS (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY rn) AS episode FROM e0),
e2 AS (SELECT *, CASE WHEN lag(episode) OVER w IS DISTINCT FROM episode OR lag(correct) OVER w IS DISTINCT FROM correct THEN 1 ELSE 0 END AS nw2,
  coalesce(lead(correct) OVER w = 1 AND lead(episode) OVER w = episode, false) AS back FROM e1 WINDOW w AS (PARTITION BY session ORDER BY rn)),
e3 AS (SELECT *, sum(nw2) OVER (PARTITION BY session ORDER BY rn) AS run FROM e2),
wrong AS (SELECT session, run, min(state) AS state, count(*) AS n, arg_max(back, rn) AS returned FROM e3 WHERE correct = 0 GROUP BY 1, 2)"""
NB = """, nb AS (SELECT *, lead(action) OVER w AS na, lead(valid) OVER w AS nv, lead(correct) OVER w AS nc, lead(seq) OVER w AS next_seq, lag(action) OVER w AS pa, lag(valid) OVER w AS pv,
  CASE WHEN reward = 1 THEN 'R' WHEN correct = 1 THEN 'O' ELSE 'X' END AS o FROM trials WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
nb2 AS (SELECT *, lag(o) OVER w AS po, lead(o) OVER w AS no FROM nb WINDOW w AS (PARTITION BY session ORDER BY t, seq))"""

_add("t04_t05_trial_masks", trials, "session seq action reward manual block state correct valid", "SELECT * FROM trials")
_add("w01_contiguous_runs", lambda s, d: hi.contiguous_runs(trials(s, d), "action"), "session run value first_pos last_pos n",
     "SELECT session, run, min(action) AS value, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY pos) AS run FROM (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN lag(action) OVER w IS DISTINCT FROM action OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM trials WINDOW w AS (PARTITION BY session ORDER BY t, seq))) GROUP BY 1, 2")
_add("w02_incorrect_runs", lambda s, d: hi.incorrect_runs(trials(s, d)), "session run state n returned", "SELECT * FROM wrong", EPISODES)
_add("w03_recurrence", lambda s, d: hi.recurrence_without_context_change(trials(s, d)), "session eligible recurred ~fraction",
     "SELECT session, count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE e) AS recurred, CASE WHEN count(*) FILTER (WHERE e) > 0 THEN 1.0 END AS fraction FROM (SELECT *, returned AND max(run) OVER (PARTITION BY session, state) > run AS e FROM wrong) GROUP BY 1", EPISODES)
_add("w04_post_reward_excursions", lambda s, d: hi.post_reward_excursions(trials(s, d)), "session opportunities excursions ~rate",
     "SELECT *, excursions / nullif(opportunities, 0) AS rate FROM (SELECT session, count(*) FILTER (WHERE reward > 0 AND x IS NOT NULL) AS opportunities, count(*) FILTER (WHERE reward > 0 AND x <> action) AS excursions FROM (SELECT *, lead(action) OVER (PARTITION BY session ORDER BY rn) AS x FROM v) GROUP BY 1)", VALID)
_add("w05_rewarded_choice_switching", lambda s, d: hi.rewarded_choice_switching(trials(s, d)), "session n switches ~probability",
     "SELECT *, switches / nullif(n, 0) AS probability FROM (SELECT session, count(*) FILTER (WHERE valid AND nv AND reward > 0) AS n, count(*) FILTER (WHERE valid AND nv AND reward > 0 AND na <> action) AS switches FROM nb GROUP BY 1)", NB)
_add("t09_rewards_in_block", lambda s, d: hi.rewards_in_block(trials(s, d)), "session seq block_run rewards_in_block",
     "SELECT session, seq, block_run, CAST(coalesce(sum(CASE WHEN valid THEN reward ELSE 0 END) OVER (PARTITION BY session, block_run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rewards_in_block FROM runs", RUNS)
_add("c01_c02_c03_reward_counters", lambda s, d: hi.reward_counters(trials(s, d)), "session seq consecutive_rewards consecutive_omissions renewal_rewards renewal_omissions negative_value value", "SELECT *, -negative_value AS value FROM counters", COUNTERS)
_add("c04_sided_omissions", lambda s, d: hi.sided_values(trials(s, d)), "session seq omissions_left omissions_right", "SELECT * FROM sided", SIDED)
_add("c05_counterfactual_doubt", lambda s, d: hi.counterfactual_doubt(trials(s, d)), "session seq doubt_left doubt_right ~doubt_value", "SELECT * FROM doubt", SIDED)
_add("c07_trial_type_flags", lambda s, d: hi.trial_type_flags(trials(s, d)), "session seq is_switch is_stay block_entry first_switch_in_block explore",
     "SELECT *, is_switch AND sum(is_switch::INT) OVER (PARTITION BY session, block_run ORDER BY t, seq) = 1 AS first_switch_in_block, coalesce(is_switch AND pc = 1 AND pr = 1, false) AS explore FROM (SELECT *, coalesce(lag(action) OVER w <> action, false) AS is_switch, coalesce(lag(action) OVER w = action, false) AS is_stay, lag(correct) OVER w AS pc, lag(reward) OVER w AS pr, row_number() OVER (PARTITION BY session, block_run ORDER BY t, seq) = 1 AS block_entry FROM vruns WINDOW w AS (PARTITION BY session ORDER BY t, seq))", VRUNS)
_add("c10_regressors", lambda s, d: hi.regressors(trials(s, d)), "session seq ~relative_omissions persistence wsls ~hazard",
     "SELECT *, (omissions_left - omissions_right) / (omissions_left + omissions_right + 1e-9) AS relative_omissions, coalesce(2 * pa - 1, 0) AS persistence, coalesce(CASE WHEN pr = 1 THEN 2 * pa - 1 ELSE 1 - 2 * pa END, 0) AS wsls, tanh(0.2 * (omissions_right - omissions_left)) AS hazard FROM (SELECT *, lag(action) OVER w AS pa, lag(reward) OVER w AS pr FROM sided WINDOW w AS (PARTITION BY session ORDER BY rn))", SIDED)
_add("c13_terminal_omission_streaks", lambda s, d: hi.terminal_omission_streaks(trials(s, d)), "session block_run n_correct terminal_streak",
     "SELECT session, block_run, count(*) AS n_correct, count(*) FILTER (WHERE m = 0) AS terminal_streak FROM (SELECT *, max(reward) OVER (PARTITION BY session, block_run ORDER BY t DESC, seq DESC) AS m FROM runs WHERE valid AND correct = 1) GROUP BY 1, 2", RUNS)
_add("f07_greedy_choices", lambda s, d: hi.greedy_choices(hi.counterfactual_doubt(trials(s, d)), "doubt_value"), "session seq greedy", "SELECT * FROM greedy", SIDED)
_add("f08_agreement", lambda s, d: hi.agreement(hi.counterfactual_doubt(trials(s, d)), "doubt_value"), "session n ~agreement", "SELECT session, count(*) AS n, avg((greedy = action)::INT) AS agreement FROM greedy GROUP BY 1", SIDED)
_add("j14_central_motifs", lambda s, d: hi.central_motifs(trials(s, d)), "outcomes moves n",
     "SELECT po || o || no AS outcomes, CASE WHEN pa = action THEN 'r' ELSE 's' END || CASE WHEN na = action THEN 'r' ELSE 's' END AS moves, count(*) AS n FROM nb2 WHERE valid AND pv AND nv GROUP BY 1, 2", NB)
_add("j16_switch_events", lambda s, d: hi.switch_events(trials(s, d)), "session seq next_seq direction transition",
     "SELECT *, CASE WHEN na = 1 THEN 'to_left' ELSE 'to_right' END AS direction, CASE WHEN correct = 1 THEN 'correct' ELSE 'wrong' END || '_to_' || CASE WHEN nc = 1 THEN 'correct' ELSE 'wrong' END AS transition FROM nb WHERE valid AND nv AND na <> action", NB)
_add("a01_percent_correct", lambda s, d: su.percent_correct(trials(s, d)), "session state n ~accuracy", "SELECT session, state, count(*) AS n, avg(correct) AS accuracy FROM v GROUP BY GROUPING SETS ((session, state), (session))", VALID)
_add("a02_a13_blocks", lambda s, d: su.blocks(trials(s, d)), "session block_run state n_trials n_valid trials_to_correct ~accuracy_after n_rewarded prev_n_rewarded prev_n_trials ~bias_rl ~bias_inf rl_status",
     "SELECT *, (trials_to_correct - prev_n_rewarded) / (trials_to_correct + prev_n_rewarded + 1e-9) AS bias_rl, (trials_to_correct - 4) / (trials_to_correct + 4) AS bias_inf, CASE WHEN trials_to_correct < floor(prev_n_rewarded / 2) THEN 'below_rl_threshold' WHEN (trials_to_correct - prev_n_rewarded) / (trials_to_correct + greatest(prev_n_rewarded, 1)) > 0.2 THEN 'biased_rl' WHEN trials_to_correct IS NOT NULL THEN 'valid_rl' END AS rl_status FROM blocks", BLOCKS)
_add("a02_blocks_from_first", lambda s, d: su.blocks(trials(s, d)), "session block_run ~accuracy_from_first prev_n_valid",
     "SELECT session, block_run, f AS accuracy_from_first, lag(k) OVER (PARTITION BY session ORDER BY block_run) AS prev_n_valid FROM (SELECT session, block_run, avg(correct) FILTER (WHERE valid AND pos >= ttc) AS f, count(*) FILTER (WHERE valid) AS k FROM b1 GROUP BY 1, 2)", BLOCKS)
_add("a04_block_switches", lambda s, d: su.block_switches(trials(s, d)), "session block_run switches n ~switch_rate",
     "SELECT *, switches / nullif(n - 1, 0) AS switch_rate FROM (SELECT session, block_run, CAST(coalesce(sum((f <> pf)::INT), 0) AS BIGINT) AS switches, count(*) AS n FROM (SELECT *, lag(f) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS pf FROM (SELECT *, coalesce(action, last_value(action IGNORE NULLS) OVER (PARTITION BY session, block_run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(action IGNORE NULLS) OVER (PARTITION BY session, block_run ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS f FROM runs)) GROUP BY 1, 2)", RUNS)
_add("a07_zero_ttc", lambda s, d: su.zero_ttc(su.blocks(trials(s, d))), "session state n n_zero ~fraction",
     "SELECT *, n_zero / nullif(n, 0) AS fraction FROM (SELECT session, state, count(trials_to_correct) AS n, count(*) FILTER (WHERE trials_to_correct = 0) AS n_zero FROM blocks WHERE block_run > 1 GROUP BY GROUPING SETS ((session, state), (session)))", BLOCKS)
_add("a08_a24_quartile_card", lambda s, d: su.quartile_card(su.blocks(trials(s, d)), ["session"], "trials_to_correct"), "session n ~q1 ~median ~q3",
     "SELECT session, count(trials_to_correct) AS n, quantile_cont(trials_to_correct, 0.25) AS q1, quantile_cont(trials_to_correct, 0.5) AS median, quantile_cont(trials_to_correct, 0.75) AS q3 FROM blocks GROUP BY 1", BLOCKS)
_add("a09_side_bias", lambda s, d: su.side_bias(trials(s, d)), "session n_left n_right true_left n ~left_ratio ~signed_bias",
     "SELECT *, n_left / nullif(true_left, 0) AS left_ratio, (n_left - n_right) / n AS signed_bias FROM (SELECT session, count(*) FILTER (WHERE action = 1) AS n_left, count(*) FILTER (WHERE action = 0) AS n_right, count(*) FILTER (WHERE state = 1) AS true_left, count(*) AS n FROM v GROUP BY 1)", VALID)
_add("a11_session_regression", lambda s, d: su.session_regression(su.blocks(trials(s, d))), "session n ~slope ~intercept",
     "SELECT session, count(*) AS n, regr_slope(trials_to_correct, prev_n_rewarded) AS slope, regr_intercept(trials_to_correct, prev_n_rewarded) AS intercept FROM blocks WHERE trials_to_correct IS NOT NULL AND block_run > 1 GROUP BY 1", BLOCKS)
PERSIST = RUNS + """, sd AS (SELECT *, lag(side) OVER (PARTITION BY session ORDER BY block_run) AS was FROM (SELECT session, block_run, min(state) AS side FROM runs GROUP BY 1, 2)),
p1 AS (SELECT r.*, side, row_number() OVER (PARTITION BY session, block_run ORDER BY t, seq) - 1 AS pos FROM runs r JOIN sd USING (session, block_run) WHERE was <> side),
p2 AS (SELECT *, min(pos) FILTER (WHERE action = side) OVER (PARTITION BY session, block_run) AS f FROM p1),
p3 AS (SELECT *, max((pos <= f AND NOT valid)::INT) OVER (PARTITION BY session, block_run) AS bad FROM p2),
p4 AS (SELECT CASE WHEN side = 1 THEN 'to_left' ELSE 'to_right' END AS direction, pos AS choice_index, (pos = f)::INT AS switched FROM p3 WHERE f IS NOT NULL AND bad = 0 AND pos <= f)"""
_add("a15_a16_switch_persistence", lambda s, d: su.switch_persistence(trials(s, d)), "direction choice_index n n_switch ~p_switch",
     "SELECT *, n_switch / n AS p_switch FROM (SELECT direction, choice_index, count(*) AS n, CAST(sum(switched) AS BIGINT) AS n_switch FROM p4 GROUP BY GROUPING SETS ((direction, choice_index), (choice_index)))", PERSIST)
_add("a17_post_first_correct", lambda s, d: su.post_first_correct(trials(s, d)), "state ix n ~accuracy",
     "SELECT state, ix, count(*) AS n, avg(correct) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY session, block_run ORDER BY t, seq) - 1 AS ix FROM (SELECT *, sum(correct) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS c FROM runs WHERE valid) WHERE c >= 1) GROUP BY GROUPING SETS ((state, ix), (ix))", RUNS)
_add("a17_post_first_correct_all", lambda s, d: su.post_first_correct(trials(s, d)), "state ix n ~accuracy",
     "SELECT state, ix, count(*) AS n, avg(correct) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY session, block_run ORDER BY t, seq) - 1 AS ix FROM (SELECT *, sum(correct) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS c FROM runs WHERE valid) WHERE c >= 1) GROUP BY GROUPING SETS ((state, ix), (ix))", RUNS)
_add("a19_choice_windows", lambda s, d: su.choice_windows(hi.greedy_choices(hi.counterfactual_doubt(trials(s, d)), "doubt_value")), "session win ~agreement rewards transitions",
     "SELECT session, win, avg((greedy = action)::INT) AS agreement, CAST(sum(reward) AS BIGINT) AS rewards, CAST(sum(coalesce((block <> pb)::INT, 0)) AS BIGINT) AS transitions FROM (SELECT *, CAST(floor((rn - 1) / 10) AS BIGINT) AS win, lag(block) OVER (PARTITION BY session ORDER BY rn) AS pb FROM greedy) GROUP BY 1, 2 HAVING count(*) = 10", SIDED)
_add("a20_choice_window_sessions", lambda s, d: su.quartile_card(su.choice_windows(hi.greedy_choices(hi.counterfactual_doubt(trials(s, d)), "doubt_value")), ["session"], "agreement"), "session n ~q1 ~median ~q3",
     "SELECT session, count(*) AS n, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.5) AS median, quantile_cont(a, 0.75) AS q3 FROM (SELECT session, avg((greedy = action)::INT) AS a FROM (SELECT *, floor((rn - 1) / 10) AS win FROM greedy) GROUP BY session, win HAVING count(*) = 10) GROUP BY 1", SIDED)
_add("a25_learning_curve", lambda s, d: su.learning_curve(trials(s, d)), "session number n ~accuracy", "SELECT session, block_run AS number, count(*) AS n, avg(correct) AS accuracy FROM vruns GROUP BY 1, 2", VRUNS)
_add("a26_sliding_regression", lambda s, d: su.sliding_regression(su.blocks(trials(s, d))), "session pos ~slope",
     "SELECT session, pos, CASE WHEN isnan(slope) OR slope IS NULL THEN 0 ELSE slope END AS slope FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY block_run) - 1 AS pos, count(*) OVER w AS n, regr_slope(trials_to_correct, prev_n_rewarded) OVER w AS slope FROM blocks WHERE trials_to_correct IS NOT NULL AND block_run > 1 WINDOW w AS (PARTITION BY session ORDER BY block_run ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 AND pos % 2 = 0", BLOCKS)
_add("a27_centred_rewards", lambda s, d: su.centred_rewards(su.blocks(trials(s, d))), "session block_run ~centred side_code", "SELECT session, block_run, prev_n_rewarded - avg(prev_n_rewarded) OVER (PARTITION BY session) AS centred, 2 * state - 1 AS side_code FROM blocks", BLOCKS)
_add("a28_residual_spread", lambda s, d: su.residual_spread(table(s, d, "events").where("value IS NOT NULL"), ["event_type"], "value"), "event_type ~mad ~iqr ~rmse ~sd ~mad_scaled",
     "SELECT event_type, quantile_cont(abs(value - m), 0.5) AS mad, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, sqrt(avg(value * value)) AS rmse, stddev_samp(value) AS sd, quantile_cont(abs(value - m), 0.5) * 1.4826 AS mad_scaled FROM events JOIN (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) USING (event_type) WHERE value IS NOT NULL GROUP BY 1")
_add("a29_switches_by_omissions", lambda s, d: su.switches_by_omissions(trials(s, d)), "session omissions n switches ~p_switch",
     "SELECT session, o AS omissions, count(*) AS n, CAST(sum(sw) AS BIGINT) AS switches, avg(sw) AS p_switch FROM (SELECT session, consecutive_omissions AS o, (action <> lag(action) OVER (PARTITION BY session ORDER BY rn))::INT AS sw FROM counters) WHERE sw IS NOT NULL GROUP BY GROUPING SETS ((session, o), (o))", COUNTERS)
_add("a29_switches_by_omissions_all", lambda s, d: su.switches_by_omissions(trials(s, d)), "session omissions n switches ~p_switch",
     "SELECT session, o AS omissions, count(*) AS n, CAST(sum(sw) AS BIGINT) AS switches, avg(sw) AS p_switch FROM (SELECT session, consecutive_omissions AS o, (action <> lag(action) OVER (PARTITION BY session ORDER BY rn))::INT AS sw FROM counters) WHERE sw IS NOT NULL GROUP BY GROUPING SETS ((session, o), (o))", COUNTERS)


def _sessions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    per = table(s, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.avg("o_totalprice").alias("price"))
    nation = table(s, d, "nation")
    groups = table(s, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("session"), F.col("n_name").alias("group"), F.col("n_regionkey").alias("region"))
    return per, groups


_add("a21_cohort_means", lambda s, d: su.cohort_means(*_sessions(s, d), "price").withColumnRenamed("group", "grp"), "grp region n ~mean",
     "SELECT n_name AS grp, n_regionkey AS region, count(*) AS n, avg(price) AS mean FROM (SELECT o_custkey, avg(o_totalprice) AS price FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")

HOUR = 3600 * al.MICROS
MICRO_SQL = ", pt AS (SELECT user_id AS session, event_id AS seq, event_type AS unit, epoch_us(ts) AS t FROM events), ct AS (SELECT session, seq AS ref, t AS t0 FROM pt WHERE unit = 'purchase')"


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("unit"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def _centres(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).where("unit = 'purchase'").select("session", F.col("seq").alias("ref"), F.col("t").alias("t0"))


_add("j01_peri_event_extract", lambda s, d: al.interval_join(_points(s, d), _centres(s, d), -6 * HOUR, 6 * HOUR), "session seq ref rel", f"SELECT session, seq, ref, t - t0 AS rel FROM pt JOIN ct USING (session) WHERE t - t0 BETWEEN {-6 * HOUR} AND {6 * HOUR}", MICRO_SQL)
_add("j02_psth", lambda s, d: al.psth(_points(s, d), _centres(s, d), -6 * HOUR, 12, HOUR), "unit bin n ~rate",
     f"SELECT unit, bin, coalesce(n, 0) AS n, coalesce(n, 0) / ((SELECT count(*) FROM ct) * 3600.0) AS rate FROM (SELECT DISTINCT unit FROM pt) CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS bin) LEFT JOIN (SELECT unit, CAST(least((t - t0 + {6 * HOUR}) // {HOUR}, 11) AS INTEGER) AS bin, count(*) AS n FROM pt JOIN ct USING (session) WHERE t - t0 BETWEEN {-6 * HOUR} AND {6 * HOUR} GROUP BY 1, 2) USING (unit, bin)", MICRO_SQL)
_add("j09_merge_windows", lambda s, d: al.merge_windows(_points(s, d).select("session", F.col("t").alias("start"), (F.col("t") + 12 * HOUR).alias("stop"))), "session island start stop n",
     f"SELECT session, island, min(t) AS start, max(t) + {12 * HOUR} AS stop, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY session ORDER BY t) + {12 * HOUR} >= t THEN 0 ELSE 1 END AS nw FROM pt)) GROUP BY 1, 2", MICRO_SQL)
_add("j10_context_intervals", lambda s, d: al.context_intervals(_points(s, d).where("unit = 'signup'")), "session seq start stop", "SELECT session, seq, t AS start, lead(t) OVER (PARTITION BY session ORDER BY t, seq) AS stop FROM pt WHERE unit = 'signup'", MICRO_SQL)
_add("p02_phase_locking", lambda s, d: al.phase_locking(_points(s, d).withColumn("phase", F.col("t") % (24 * HOUR) / (24 * HOUR) * 6.283185307179586), ["unit"], "phase"), "unit n ~resultant ~ppc ~direction reliable",
     f"SELECT unit, n, sqrt(c * c + s * s) / n AS resultant, (c * c + s * s - n) / (n * (n - 1)) AS ppc, atan2(s, c) AS direction, n >= 50 AS reliable FROM (SELECT unit, count(*) AS n, sum(cos(p)) AS c, sum(sin(p)) AS s FROM (SELECT unit, (t % {24 * HOUR}) / {24 * HOUR} * 6.283185307179586 AS p FROM pt) GROUP BY 1)", MICRO_SQL)
_add("p03_phase_histogram", lambda s, d: al.phase_histogram(_points(s, d).withColumn("phase", F.col("t") % (24 * HOUR) / (24 * HOUR) * 6.283185307179586), "unit", "phase"), "unit bin n",
     f"SELECT unit, CAST(least(floor((t % {24 * HOUR}) / {24 * HOUR} * 6.283185307179586 / 6.283185307179586 * 12), 11) AS INTEGER) AS bin, count(*) AS n FROM pt GROUP BY 1, 2", MICRO_SQL)
DAILY = ", ds AS (SELECT 'all' AS series, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS i, count(*) AS v FROM orders GROUP BY 1, 2)"


def _daily(s: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(s, d, "orders").groupBy(F.lit("all").alias("series"), day.alias("i")).agg(F.count("*").alias("v"))


_add("g01_signal_edges", lambda s, d: al.signal_edges(_daily(s, d), 7), "series rise fall width",
     "SELECT series, i AS rise, fall, fall - i AS width FROM (SELECT *, min(CASE WHEN v < 7 AND pv >= 7 THEN i END) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fall FROM (SELECT *, lag(v, 1, 0) OVER (PARTITION BY series ORDER BY i) AS pv FROM ds)) WHERE v >= 7 AND pv < 7 AND fall IS NOT NULL", DAILY)
_add("g05_running_stats", lambda s, d: al.running_stats(_daily(s, d)), "series i ~mean step", "SELECT series, i, avg(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mean, v - lag(v) OVER (PARTITION BY series ORDER BY i) AS step FROM ds", DAILY)
_add("g06_hysteresis", lambda s, d: al.hysteresis(_daily(s, d), 4, 8), "series i is_on", "SELECT series, i, coalesce(last_value(CASE WHEN v >= 8 THEN 1 WHEN v <= 4 THEN 0 END IGNORE NULLS) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS is_on FROM ds", DAILY)
LONG = ", lv AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS unit, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), cm AS (SELECT label, unit, avg(x) AS mean, count(*) AS n FROM lv GROUP BY 1, 2)"
_add("m01_scaling", lambda s, d: ve.scaling(ve.long_form(table(s, d, "embeddings"), "vec_id", "embedding")), "unit ~mean ~sd", "SELECT unit, avg(x) AS mean, stddev_pop(x) AS sd FROM lv GROUP BY 1 HAVING stddev_pop(x) > 0", LONG)
_add("m17_condition_means", lambda s, d: ve.condition_means(ve.long_form(table(s, d, "embeddings"), "vec_id", "embedding", "label"), "label"), "label unit ~mean n", "SELECT * FROM cm", LONG)
_add("m18_condition_cosines", lambda s, d: ve.condition_cosines(ve.condition_means(ve.long_form(table(s, d, "embeddings"), "vec_id", "embedding", "label"), "label"), "label"), "a b ~cosine",
     "SELECT x.label AS a, y.label AS b, sum(x.mean * y.mean) / (sqrt(sum(x.mean * x.mean)) * sqrt(sum(y.mean * y.mean))) AS cosine FROM cm x JOIN cm y ON x.unit = y.unit AND x.label < y.label GROUP BY 1, 2", LONG)


def _scored(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 1500)).alias("score"))
    return docs.join(table(s, d, "labels"), "doc_id")


_add("m15_binary_metrics", lambda s, d: ve.binary_metrics(_scored(s, d), ["lang"], "score", "quality"), "lang n ~accuracy ~balanced_accuracy ~precision ~recall ~brier ~auc",
     "SELECT lang, count(*) AS n, avg((h = quality)::INT) AS accuracy, (avg(h) FILTER (WHERE quality = 1) + avg(1 - h) FILTER (WHERE quality = 0)) / 2 AS balanced_accuracy, avg(quality) FILTER (WHERE h = 1) AS precision, avg(h) FILTER (WHERE quality = 1) AS recall, avg((score - quality) ^ 2) AS brier, (sum(r) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / nullif(sum(quality) * (count(*) - sum(quality)), 0) AS auc FROM (SELECT *, (score >= 0.5)::INT AS h, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM (SELECT lang, n_chars / (n_chars + 1500) AS score, quality FROM documents JOIN labels USING (doc_id))) GROUP BY 1")

# Replays: the recursion of the SQL walks the trials one by one.
REPLAY = VALID + """, fold(session, rn, seq, action, reward, ql, qr, fq, num, den, hm, hd) AS (
  SELECT session, rn, seq, action, reward, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE FROM v WHERE rn = 1
  UNION ALL SELECT session, rn, seq, action, reward, ql, qr, fq, num, den, h0 * 0.95 + (1 - h0) * 0.05, d0 * 0.95 + (1 - d0) * 0.05 FROM (
    SELECT n.session, n.rn, n.seq, n.action, n.reward, f.ql + CASE WHEN f.action = 1 THEN 0.1 * (f.reward - f.ql) ELSE 0 END AS ql, f.qr + CASE WHEN f.action = 0 THEN 0.1 * (f.reward - f.qr) ELSE 0 END AS qr,
      0.9 * f.fq + 0.1 * f.reward * (2 * f.action - 1) AS fq, exp(-0.5) * (f.num + 2 * f.action - 1) AS num, exp(-0.5) * (f.den + 1) AS den,
      (f.hm * a + 5e-13) / (f.hm * a + (1 - f.hm) * b + 1e-12) AS h0,
      CASE WHEN f.reward = 1 THEN (f.hd * a + 5e-13) / (f.hd * a + (1 - f.hd) * b + 1e-12) ELSE 1 / (1 + exp(-0.7 * ln(f.hd / (1 - f.hd)))) END AS d0
    FROM (SELECT *, CASE WHEN action = 1 THEN CASE WHEN reward = 1 THEN 0.8 ELSE 0.2 END ELSE CASE WHEN reward = 1 THEN 0.1 ELSE 0.9 END END::DOUBLE AS a,
      CASE WHEN action = 1 THEN CASE WHEN reward = 1 THEN 0.1 ELSE 0.9 END ELSE CASE WHEN reward = 1 THEN 0.8 ELSE 0.2 END END::DOUBLE AS b FROM fold) f JOIN v n ON n.session = f.session AND n.rn = f.rn + 1))"""
_add("f01_q_learning", lambda s, d: rp.q_learning(trials(s, d)), "session seq ~q_left ~q_right ~q_value", "SELECT session, seq, ql AS q_left, qr AS q_right, ql - qr AS q_value FROM fold", REPLAY)
_add("f02_forgetting_q", lambda s, d: rp.forgetting_q(trials(s, d)), "session seq ~fq_value", "SELECT session, seq, fq AS fq_value FROM fold", REPLAY)
_add("c10_perseveration", lambda s, d: rp.perseveration(trials(s, d)), "session seq ~perseveration", "SELECT session, seq, CASE WHEN den = 0 THEN 0 ELSE num / den END AS perseveration FROM fold", REPLAY)
_add("f00_f03_hmm_value", lambda s, d: rp.hmm_value(trials(s, d)), "session seq ~hmm_value", "SELECT session, seq, ln(hm / (1 - hm)) AS hmm_value FROM fold", REPLAY)
_add("f04_hmm_reward_decay", lambda s, d: rp.hmm_reward_decay(trials(s, d)), "session seq ~hmm_decay_value", "SELECT session, seq, tanh(0.5 * ln(hd / (1 - hd))) AS hmm_decay_value FROM fold", REPLAY)
EXPECT = SIDED + """, x0 AS (SELECT *, last_value(CASE WHEN reward = 1 THEN action END IGNORE NULLS) OVER (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS home FROM doubt),
x1 AS (SELECT *, coalesce((SELECT count(*) FROM v b WHERE b.session = x0.session AND b.rn < x0.rn AND b.reward = 1 AND b.rn > coalesce((SELECT max(c.rn) FROM v c WHERE c.session = x0.session AND c.rn < x0.rn AND c.reward = 1 AND c.action <> x0.home), 0)), 0) AS home_rewards FROM x0),
expect AS (SELECT *, tanh(coalesce((2 * home - 1) * -tanh(home_rewards - 3), 0) - doubt_value) AS expectancy_value FROM x1)"""


def _expect(s: SparkSession, d: str) -> DataFrame:
    return rp.expectancy(hi.counterfactual_doubt(trials(s, d)))


_add("f05_expectancy", _expect, "session seq home_rewards ~expectancy_value ~p_left", "SELECT *, (1 + expectancy_value) / 2 AS p_left FROM expect", EXPECT)
_add("a34_signed_probability", lambda s, d: _expect(s, d).select("session", "seq", rp.signed_to_probability(F.col("expectancy_value"), "logistic", 2.0).alias("p")), "session seq ~p",
     "SELECT session, seq, 1 / (1 + exp(-atanh(least(greatest(expectancy_value, -1 + 1e-8), 1 - 1e-8)) / 2)) AS p FROM expect", EXPECT)
_add("f09_f10_score_replay", lambda s, d: rp.score_replay(rp.choice_probability(_expect(s, d), "expectancy_value", "logistic", 0.5)), "session n ~mean_probability ~nll ~switch_brier ~agreement",
     "SELECT session, count(*) AS n, avg(p) AS mean_probability, avg(-ln(greatest(p, 1e-6))) AS nll, avg((CASE WHEN pa = 1 THEN 1 - pl ELSE pl END - (action <> pa)::INT) ^ 2) AS switch_brier, avg(CASE WHEN pl = 0.5 THEN 0.5 WHEN (pl > 0.5) = (action = 1) THEN 1 ELSE 0 END) AS agreement FROM (SELECT *, CASE WHEN action = 1 THEN pl ELSE 1 - pl END AS p, lag(action) OVER (PARTITION BY session ORDER BY rn) AS pa FROM (SELECT *, 1 / (1 + exp(-expectancy_value / 0.5)) AS pl FROM expect)) GROUP BY 1", EXPECT)
_add("f06_model_panel", lambda s, d: rp.model_panel(hi.counterfactual_doubt(trials(s, d))).groupBy("session", "policy").agg(F.count("*").alias("n"), F.avg("agree").alias("agreement")), "session policy n ~agreement",
     "SELECT session, policy, count(*) AS n, avg(CASE WHEN x = 0 THEN 0.5 WHEN (x > 0) = (action = 1) THEN 1 ELSE 0 END) AS agreement FROM (SELECT session, action, unnest(['chance', 'persistence', 'wsls', 'inverse_wsls', 'doubt']) AS policy, unnest([0, same, same * paid, -same * paid, -doubt_value]) AS x FROM (SELECT *, coalesce(2 * lag(action) OVER w - 1, 0) AS same, CASE WHEN lag(reward) OVER w = 1 THEN 1 ELSE -1 END AS paid FROM doubt WINDOW w AS (PARTITION BY session ORDER BY rn))) GROUP BY 1, 2", SIDED)
LOG = """, lg AS (SELECT user_id AS session, ts AS t, event_id AS seq, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'enter_left_patch' ELSE 'enter_right_patch' END WHEN 'view' THEN 'trial_start'
  WHEN 'click' THEN 'correct_choice_right_patch' WHEN 'purchase' THEN 'correct_choice_left_patch' WHEN 'error' THEN 'invalid_switch' END AS event, CASE WHEN coalesce(value, 0) >= 20 THEN 'reward_True' ELSE 'reward_False' END AS note FROM events),
lt AS (SELECT *, sum((event = 'trial_start')::INT) OVER w AS trial, sum((event LIKE 'enter_%')::INT) OVER w AS block, last_value(CASE event WHEN 'enter_left_patch' THEN 1 WHEN 'enter_right_patch' THEN 0 END IGNORE NULLS) OVER w AS side FROM lg WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
asm AS (SELECT session, trial, min(block) FILTER (WHERE event = 'trial_start') AS block, min(side) FILTER (WHERE event = 'trial_start') AS side, count(*) FILTER (WHERE e) AS n_outcomes, coalesce(first(event ORDER BY t, seq) FILTER (WHERE e), 'unknown') AS outcome, first(note ORDER BY t, seq) FILTER (WHERE e) AS note
  FROM (SELECT *, event LIKE '%_choice_%' OR event = 'invalid_switch' AS e FROM lt WHERE trial > 0) GROUP BY 1, 2),
asm2 AS (SELECT * FROM (SELECT *, max(trial) OVER (PARTITION BY session) AS m FROM asm) WHERE n_outcomes > 0 OR trial < m)"""


def _log(s: SparkSession, d: str) -> DataFrame:
    return _log_of(table(s, d, "events"))


def _log_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", F.when(F.col("event_id") % 2 == 0, "enter_left_patch").otherwise("enter_right_patch")).when(kind == "view", "trial_start")
        .when(kind == "click", "correct_choice_right_patch").when(kind == "purchase", "correct_choice_left_patch").when(kind == "error", "invalid_switch")
    )
    note = F.when(F.coalesce("value", F.lit(0.0)) >= 20, "reward_True").otherwise("reward_False")
    return events.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("seq"), event.alias("event"), note.alias("note"))


_add("t01_t02_assemble_trials", lambda s, d: asm.decode_outcomes(asm.assemble_trials(_log(s, d))), "session trial block side n_outcomes outcome action correct reward",
     "SELECT *, a AS action, CASE WHEN a IS NOT NULL THEN 1 END AS correct, CASE WHEN a IS NOT NULL THEN (note = 'reward_True')::INT END AS reward FROM (SELECT *, CASE outcome WHEN 'correct_choice_left_patch' THEN 1 WHEN 'correct_choice_right_patch' THEN 0 END AS a FROM asm2)", LOG)
_add("s07_event_categories", lambda s, d: _log(s, d).groupBy(asm.event_category(F.col("event")).alias("category")).agg(F.count("*").alias("n")), "category n",
     "SELECT CASE WHEN event LIKE '%_choice_%' OR event = 'invalid_switch' THEN 'choice' WHEN event LIKE 'enter_%' THEN 'context' WHEN event = 'trial_start' THEN 'trial' END AS category, count(*) AS n FROM lg GROUP BY 1", LOG)
_add("t08_augment", lambda s, d: asm.augment(trials(s, d)), "session seq prev_action prev_reward trial_in_block",
     "SELECT *, lag(action) OVER w AS prev_action, lag(reward) OVER w AS prev_reward, row_number() OVER (PARTITION BY session, block_run ORDER BY t, seq) - 1 AS trial_in_block FROM runs WINDOW w AS (PARTITION BY session ORDER BY t, seq)", RUNS)
_add("j18_neighbour_targets", lambda s, d: asm.neighbour_targets(trials(s, d)), "session seq prev_action prev_reward next_action switched will_switch reason",
     "SELECT *, (action <> prev_action)::INT AS switched, (action <> next_action)::INT AS will_switch, concat_ws(';', CASE WHEN NOT valid THEN 'no_valid_choice' END, CASE WHEN NOT coalesce(pv, false) THEN 'previous_not_valid' END, CASE WHEN NOT coalesce(nv, false) THEN 'next_not_valid' END) AS reason FROM (SELECT *, CASE WHEN valid AND pv THEN pa END AS prev_action, CASE WHEN valid AND pv THEN pr END AS prev_reward, CASE WHEN valid AND nv THEN na END AS next_action FROM (SELECT *, lag(valid) OVER w AS pv, lead(valid) OVER w AS nv, lag(action) OVER w AS pa, lead(action) OVER w AS na, lag(reward) OVER w AS pr FROM trials WINDOW w AS (PARTITION BY session ORDER BY t, seq)))")
_add("a18_previous_block_omissions", lambda s, d: asm.previous_block_omissions(trials(s, d)), "session block_run prev_omissions prev_streak",
     "SELECT session, block_run, CAST(coalesce(lag(n) OVER w, 0) AS BIGINT) AS prev_omissions, CAST(coalesce(lag(k) OVER w, 0) AS BIGINT) AS prev_streak FROM (SELECT session, block_run, count(*) FILTER (WHERE c AND reward = 0) AS n, count(*) FILTER (WHERE c AND m = 0) AS k FROM (SELECT *, max(CASE WHEN c THEN reward ELSE 0 END) OVER (PARTITION BY session, block_run ORDER BY t DESC, seq DESC) AS m FROM (SELECT *, coalesce(valid AND correct = 1, false) AS c FROM runs)) GROUP BY 1, 2) WINDOW w AS (PARTITION BY session ORDER BY block_run)", RUNS)


def _relative(s: SparkSession, d: str) -> DataFrame:
    per = su.blocks(trials(s, d))
    return asm.relative_tts(per, su.session_regression(per))


_add("a12_relative_tts", _relative, "session block_run ~predicted ~residual ~percentile",
     "SELECT *, CASE WHEN n = 1 THEN 0 ELSE (k + (ties - 1) / 2 - 1) / (n - 1) END AS percentile FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n, rank() OVER (PARTITION BY session ORDER BY round(residual, 9)) AS k, count(*) OVER (PARTITION BY session, round(residual, 9)) AS ties FROM (SELECT session, block_run, b + a * prev_n_rewarded AS predicted, trials_to_correct - (b + a * prev_n_rewarded) AS residual FROM blocks JOIN (SELECT session, regr_slope(trials_to_correct, prev_n_rewarded) AS a, regr_intercept(trials_to_correct, prev_n_rewarded) AS b FROM blocks WHERE trials_to_correct IS NOT NULL AND block_run > 1 GROUP BY 1) USING (session) WHERE trials_to_correct IS NOT NULL AND block_run > 1) WHERE residual IS NOT NULL AND NOT isnan(residual))", BLOCKS)
WELCH = """, es AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, coalesce(value, 0) AS v FROM events),
sg AS (SELECT series, i, v, s, i - s * 16 AS k FROM (SELECT *, unnest([i // 16, i // 16 - 1]) AS s, max(i) OVER (PARTITION BY series) AS m FROM es) WHERE s >= 0 AND s * 16 + 31 <= m),
wd AS (SELECT *, (v - avg(v) OVER (PARTITION BY series, s)) * (0.5 - 0.5 * cos(2 * pi() * k / 32)) AS x FROM sg),
ft AS (SELECT series, s, f, sum(x * cos(2 * pi() * k * f / 32)) AS re, sum(x * sin(2 * pi() * k * f / 32)) AS im FROM wd CROSS JOIN (SELECT unnest(range(17)) AS f) GROUP BY 1, 2, 3),
psd AS (SELECT series, CAST(f AS INTEGER) AS f, avg((CASE WHEN f IN (0, 16) THEN 1 ELSE 2 END) * (re * re + im * im) / (0.375 * 32)) AS density, count(*) AS segments, f / 32 AS frequency FROM ft GROUP BY series, f)"""


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    rows = numbered(table(s, d, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], "i")
    return asm.welch(rows.select(F.col("event_type").alias("series"), "i", F.coalesce("value", F.lit(0.0)).alias("v")), 1.0, 32)


_add("g09_welch", _spectrum, "series f ~density segments ~frequency", "SELECT * FROM psd", WELCH)
_add("g11_band_power", lambda s, d: asm.band_power(_spectrum(s, d), 0.1, 0.3), "series ~power",
     "SELECT series, sum((density + d2) / 2 * (f2 - frequency)) / (max(frequency) - min(frequency)) AS power FROM (SELECT *, lead(density) OVER w AS d2, lead(frequency) OVER w AS f2 FROM psd WHERE frequency BETWEEN 0.1 AND 0.3 WINDOW w AS (PARTITION BY series ORDER BY frequency)) GROUP BY 1", WELCH)
_add("s09_table_digest", lambda s, d: asm.table_digest(table(s, d, "customer"), "c_nationkey", ["c_custkey", "c_mktsegment"]), "c_nationkey n digest",
     "SELECT c_nationkey, count(*) AS n, CAST(sum(('0x' || substr(sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_mktsegment)), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM customer GROUP BY 1")

# Labels, clocks, recoding and sums over sessions.
_add("t03_finish_trials", lambda s, d: fe.finish_trials(trials(s, d), "t", 0, 10 * 86400, p_reward=0.8), "session seq ~session_time p_reward",
     "SELECT * FROM (SELECT *, epoch(t) - min(epoch(t)) OVER (PARTITION BY session) AS session_time, 0.8::DOUBLE AS p_reward FROM trials) WHERE session_time BETWEEN 0 AND 864000")
_add("t06_t07_labels", lambda s, d: trials(s, d).withColumn("cue", F.when(F.col("reward") == 1, 1)).select("session", "seq", fe.block_type("state", "cue").alias("block_type"), fe.numeric_label("correct", F.col("valid")).alias("is_correct")), "session seq block_type is_correct",
     "SELECT session, seq, CASE WHEN state = 1 THEN 'left' ELSE 'right' END || CASE WHEN reward = 1 THEN '_cued' ELSE '_uncued' END AS block_type, correct AS is_correct FROM trials")


def _messages(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "syncPinState").otherwise(F.col("event_type"))
    return table(s, d, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("t"), F.col("event_id").alias("seq"), kind.alias("label"), (F.col("event_id") % 1000).alias("interval"))


_add("t12_sync_clock", lambda s, d: fe.sync_clock(_messages(s, d)), "session seq ~clock",
     "SELECT user_id AS session, event_id AS seq, (coalesce(sum(CASE WHEN event_type = 'signup' THEN event_id % 1000 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + event_id % 1000) / 1e6 AS clock FROM events")
_add("t13_zero_hold", lambda s, d: fe.zero_hold(_points(s, d).join(table(s, d, "events").select(F.col("event_id").alias("seq"), "value"), "seq").groupBy("session", (F.col("t") / HOUR - 473000).alias("t")).agg(F.max(F.when(F.col("value") >= 20, F.col("value")).otherwise(0.0)).alias("v")), 2.0, 1.0), "session ~t ~v added",
     f"SELECT session, t, v, false AS added FROM zh UNION ALL SELECT session, nx - 1.0, v, true FROM (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t) AS nx FROM zh) WHERE v = 0 AND nx - t > 2",
     f", zh AS (SELECT user_id AS session, epoch_us(ts) / {HOUR}::DOUBLE - 473000 AS t, max(CASE WHEN value >= 20 THEN value ELSE 0 END) AS v FROM events GROUP BY 1, 2)")
_add("c09_leave_stay", lambda s, d: fe.leave_stay(trials(s, d)), "session seq prev_action stay", "SELECT session, seq, prev_action, (action = prev_action)::INT AS stay FROM (SELECT *, lag(action) OVER (PARTITION BY session ORDER BY t, seq) AS prev_action FROM trials)")
_add("c11_observer_value", lambda s, d: _expect(s, d).withColumn("observer", fe.observer_value("expectancy_value", "doubt_value")), "session seq ~observer", "SELECT session, seq, expectancy_value - doubt_value AS observer FROM expect", EXPECT)
_add("c12_residualize", lambda s, d: fe.residualize(su.blocks(trials(s, d)), "trials_to_correct", "prev_n_rewarded", "session"), "session block_run ~residual",
     "SELECT session, block_run, trials_to_correct - my - b * (prev_n_rewarded - mx) AS residual FROM blocks LEFT JOIN (SELECT session, avg(trials_to_correct) AS my, avg(prev_n_rewarded) FILTER (WHERE trials_to_correct IS NOT NULL) AS mx, coalesce(covar_pop(trials_to_correct, prev_n_rewarded) / nullif(var_pop(prev_n_rewarded) FILTER (WHERE trials_to_correct IS NOT NULL), 0), 0) AS b FROM blocks GROUP BY 1) USING (session)", BLOCKS)
_add("f11_unique_maximum", lambda s, d: fe.unique_maximum(hi.counterfactual_doubt(trials(s, d)), ["doubt_left", "doubt_right"]), "session seq winner tie", "SELECT session, seq, CASE WHEN doubt_left > doubt_right THEN 0 WHEN doubt_left < doubt_right THEN 1 ELSE -1 END AS winner, (doubt_left = doubt_right)::INT AS tie FROM sided", SIDED)
_add("f12_exclusion_reasons", lambda s, d: fe.exclusion_reasons(trials(s, d)), "session seq reason", "SELECT session, seq, concat_ws(';', CASE WHEN action IS NULL THEN 'no_choice' END, CASE WHEN manual = 1 THEN 'manual_reward' END, CASE WHEN reward IS NULL THEN 'no_reward_value' END) AS reason FROM trials")
_add("a03_block_transitions", lambda s, d: fe.block_transitions(trials(s, d)), "session block_run no_switch width reversion_choices reversion_events short",
     "SELECT session, block_run, n = 0 AS no_switch, CASE WHEN n > 0 THEN coalesce(l - f + 1, 0) END AS width, CASE WHEN n > 0 THEN k END AS reversion_choices, CASE WHEN n > 0 THEN e END AS reversion_events, n <= 2 AS short FROM (SELECT session, block_run, count(*) FILTER (WHERE seen = 1) AS n, min(i) FILTER (WHERE seen = 1) AS f, max(i) FILTER (WHERE seen = 1 AND correct = 0) AS l, count(*) FILTER (WHERE seen = 1 AND correct = 0) AS k, count(*) FILTER (WHERE seen = 1 AND correct = 0 AND was = 1) AS e FROM (SELECT *, max(correct) OVER w AS seen, lag(correct) OVER w AS was, row_number() OVER w AS i FROM runs WHERE valid WINDOW w AS (PARTITION BY session, block_run ORDER BY t, seq)) GROUP BY 1, 2)", RUNS)
_add("a06_ttc_summary", lambda s, d: fe.ttc_summary(su.blocks(trials(s, d))), "session ~left_ttc ~right_ttc ~overall_ttc n_missing",
     "SELECT session, avg(trials_to_correct) FILTER (WHERE state = 1) AS left_ttc, avg(trials_to_correct) FILTER (WHERE state = 0) AS right_ttc, avg(trials_to_correct) AS overall_ttc, count(*) FILTER (WHERE trials_to_correct IS NULL AND block_run < m) AS n_missing FROM (SELECT *, max(block_run) OVER (PARTITION BY session) AS m FROM blocks) GROUP BY 1", BLOCKS)
_add("a10_oracle_summary", lambda s, d: fe.oracle_summary(trials(s, d).withColumn("p", F.when(F.col("state") == 1, 0.8).otherwise(0.5)), "p"), "session ~accuracy collected ~expected ~fraction ~difference",
     "SELECT *, collected / expected AS fraction, collected - expected AS difference FROM (SELECT session, avg(correct) AS accuracy, CAST(sum(reward) AS BIGINT) AS collected, sum(CASE WHEN state = 1 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) AS expected FROM v GROUP BY 1)", VALID)
_add("a22_a23_agreement_delta", lambda s, d: fe.agreement_delta(hi.greedy_choices(hi.counterfactual_doubt(trials(s, d)), "doubt_value"), "greedy", "state", "session", "block"), "session block ~agree_a ~agree_b n_both only_a only_b neither ~delta",
     "SELECT *, agree_a - agree_b AS delta FROM (SELECT session, block, avg((greedy = action)::INT) AS agree_a, avg((state = action)::INT) AS agree_b, count(*) FILTER (WHERE greedy = action AND state = action) AS n_both, count(*) FILTER (WHERE greedy = action AND state <> action) AS only_a, count(*) FILTER (WHERE greedy <> action AND state = action) AS only_b, count(*) FILTER (WHERE greedy <> action AND state <> action) AS neither FROM greedy GROUP BY 1, 2)", SIDED)
_add("a30_exemplar_residuals", lambda s, d: fe.exemplar_residuals(su.blocks(trials(s, d)), "prev_n_rewarded", "trials_to_correct", {"value": (0, 1, 2), "inference": (4, 0, 1)}), "session block_run line ~residual ~z",
     "SELECT session, block_run, line, trials_to_correct - (a + b * prev_n_rewarded) AS residual, (trials_to_correct - (a + b * prev_n_rewarded)) / sd AS z FROM blocks CROSS JOIN (VALUES ('value', 0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE), ('inference', 4.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE)) AS l(line, a, b, sd)", BLOCKS)
_add("a31_inherit_state", lambda s, d: fe.inherit_state(hi.with_runs(trials(s, d), "block", "block_run"), su.blocks(trials(s, d)), ["session", "block_run"], "trials_to_correct"), "session seq trials_to_correct", "SELECT session, seq, CASE WHEN valid THEN trials_to_correct END AS trials_to_correct FROM runs LEFT JOIN (SELECT session, block_run, trials_to_correct FROM blocks) USING (session, block_run)", BLOCKS)
_add("a32_block_spans", lambda s, d: fe.block_spans(trials(s, d), F.col("correct")), "session block_run first_pos last_pos ~agreement", "SELECT session, block_run, min(p) AS first_pos, max(p) AS last_pos, avg(correct) FILTER (WHERE valid) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) - 1 AS p FROM runs) GROUP BY 1, 2", RUNS)
_add("j13_trial_masks", lambda s, d: fe.trial_masks(trials(s, d)), "session seq mask",
     "SELECT * FROM (SELECT session, seq, unnest([CASE WHEN valid THEN 'valid' END, CASE WHEN valid AND correct = 1 AND reward = 1 THEN 'correct_rewarded' END, CASE WHEN valid AND correct = 1 AND reward <> 1 THEN 'omission' END, CASE WHEN valid AND correct = 0 THEN 'incorrect' END, CASE WHEN valid AND nv AND na <> action THEN 'switch' END, CASE WHEN valid AND nv AND na = action THEN 'stay' END]) AS mask FROM nb) WHERE mask IS NOT NULL", NB)
_add("s03_restrict_points", lambda s, d: so.restrict_points(_points(s, d), _points(s, d).groupBy("session").agg(F.count("*").alias("n")).where("n >= 60"), ["session"]), "session seq t", "SELECT session, seq, t FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM pt) WHERE n >= 60", MICRO_SQL)
_add("s04_select_units", lambda s, d: so.select_units(table(s, d, "customer"), "c_nationkey", [1, 2, 3, 4, 5], "c_mktsegment", ("building", " Machinery ")), "c_custkey c_nationkey quality_label", "SELECT c_custkey, c_nationkey, lower(trim(c_mktsegment)) AS quality_label FROM customer WHERE c_nationkey BETWEEN 1 AND 5 AND lower(trim(c_mktsegment)) IN ('building', 'machinery')")
_add("s06_named_series", lambda s, d: so.named_series(table(s, d, "events"), {"click": "right_lick", "purchase": "left_lick"}, "event_type").groupBy("user_id", "series").agg(F.count("*").alias("n")), "user_id series n", "SELECT user_id, CASE event_type WHEN 'click' THEN 'right_lick' ELSE 'left_lick' END AS series, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2")
_add("s10_renumber_blocks", lambda s, d: so.renumber_blocks(hi.with_runs(trials(s, d), "block", "block_run").withColumn("subject", F.col("session") % 10), "subject", "session", "block_run"), "subject session seq global_block",
     "SELECT session % 10 AS subject, session, seq, CAST(block_run + o AS BIGINT) AS global_block FROM runs JOIN (SELECT session, coalesce(sum(m) OVER (PARTITION BY session % 10 ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT session, max(block_run) AS m FROM runs GROUP BY 1)) USING (session)", RUNS)
_add("s11_select_dates", lambda s, d: so.select_dates(table(s, d, "orders"), "o_orderdate", "1996-01-01", "1997-12-31"), "o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
_add("s12_water_delivery", lambda s, d: so.water_delivery(table(s, d, "events").select(F.col("user_id").alias("session"), F.concat(F.when(F.col("event_type") == "purchase", "pump1").when(F.col("event_type") == "click", "pump2"), F.lit(" reward_amount: "), F.col("event_id").cast("string")).alias("event"))), "session source amount",
     "SELECT user_id AS session, coalesce(CASE event_type WHEN 'purchase' THEN 'left' WHEN 'click' THEN 'right' END, 'total') AS source, CAST(sum(event_id) AS BIGINT) AS amount FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'click')) GROUP BY GROUPING SETS ((user_id, event_type), (user_id))")

# Bins, folds, phases, exemplars.
ENDS = ", ce AS (SELECT *, (ref % 7) * 3600000000 AS e FROM ct)"


def _ends(s: SparkSession, d: str) -> DataFrame:
    return _centres(s, d).withColumn("end", F.col("ref") % 7 * HOUR)


_add("j03_valid_bin_rates", lambda s, d: tl.valid_bin_rates(_points(s, d), _ends(s, d), -2 * HOUR, 8, HOUR), "unit bin trials n ~mean_count",
     f"SELECT unit, bin, trials, coalesce(n, 0) AS n, coalesce(n, 0) / trials AS mean_count FROM (SELECT DISTINCT unit FROM pt) CROSS JOIN (SELECT bin, count(*) AS trials FROM ce, (SELECT unnest(range(8)) AS bin) WHERE (bin - 1.5) * {HOUR} <= e GROUP BY 1) LEFT JOIN (SELECT unit, (t - t0 + {2 * HOUR}) // {HOUR} AS bin, count(*) AS n FROM pt JOIN ce USING (session) WHERE t - t0 BETWEEN {-2 * HOUR} AND {6 * HOUR - 1} AND ((t - t0 + {2 * HOUR}) // {HOUR} - 1.5) * {HOUR} <= e GROUP BY 1, 2) USING (unit, bin)", MICRO_SQL + ENDS)
_add("j07_j08_variable_bins", lambda s, d: tl.select_bins(tl.variable_bins(_ends(s, d).withColumn("stop", F.col("t0") + F.col("end") + HOUR // 2), HOUR), "t0", HOUR, 5 * HOUR), "session ref bin edge",
     f"SELECT session, ref, bin, t0 + bin * {HOUR} AS edge FROM ce, (SELECT unnest(range(7)) AS bin) WHERE bin < e // {HOUR} AND bin BETWEEN 1 AND 4", MICRO_SQL + ENDS)
_add("j17_scale_activity", lambda s, d: tl.scale_activity(table(s, d, "events").where("value IS NOT NULL"), "value", "user_id"), "event_id ~z", "SELECT event_id, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id)")
_add("j17_complete_episodes", lambda s, d: tl.complete_episodes(trials(s, d), trials(s, d).where("valid"), ["session", "seq"], "block"), "block n_rows n_covered complete", "SELECT block, count(*) AS n_rows, count(*) FILTER (WHERE valid) AS n_covered, bool_and(valid) AS complete FROM trials GROUP BY 1")
_add("j19_lagged", lambda s, d: tl.lagged(trials(s, d), ["session"], ["t", "seq"], ["action"], [1, 3]), "session seq action action_lag1 action_lag3", "SELECT * FROM (SELECT *, lag(action) OVER w AS action_lag1, lag(action, 3) OVER w AS action_lag3 FROM trials WINDOW w AS (PARTITION BY session ORDER BY t, seq)) WHERE action + action_lag1 + action_lag3 IS NOT NULL")
_add("j21_page", lambda s, d: tl.page(trials(s, d), ["session"], ["t", "seq"], 1, 20), "session seq", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS k FROM trials) WHERE k BETWEEN 21 AND 40")
_add("j22_grouped_folds", lambda s, d: tl.grouped_folds(trials(s, d), "session", "block"), "session block n fold",
     "SELECT session, block, n, CASE WHEN m >= 5 THEN p - 1 END AS fold FROM gw WHERE k > 0",
     """, gs AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, block) AS k, count(*) OVER (PARTITION BY session) AS m FROM (SELECT session, block, count(*) AS n FROM trials GROUP BY 1, 2)),
gw(session, k, block, n, m, p, l1, l2, l3, l4, l5) AS (SELECT DISTINCT session, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM gs
  UNION ALL SELECT session, k, block, n, m, p, l1 + CASE WHEN p = 1 THEN n ELSE 0 END, l2 + CASE WHEN p = 2 THEN n ELSE 0 END, l3 + CASE WHEN p = 3 THEN n ELSE 0 END, l4 + CASE WHEN p = 4 THEN n ELSE 0 END, l5 + CASE WHEN p = 5 THEN n ELSE 0 END
  FROM (SELECT g.session, g.k, g.block, g.n, g.m, CASE least(l1, l2, l3, l4, l5) WHEN l1 THEN 1 WHEN l2 THEN 2 WHEN l3 THEN 3 WHEN l4 THEN 4 ELSE 5 END AS p, l1, l2, l3, l4, l5 FROM gw JOIN gs g ON g.session = gw.session AND g.k = gw.k + 1))""")  # fmt: skip
HOURLY = f", hs AS (SELECT unit AS session, t // {HOUR} AS i, cos(count(*)) AS re, sin(count(*)) AS im FROM pt GROUP BY 1, 2)"


def _unit_points(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select(F.col("unit").alias("session"), "seq", (F.col("t") / HOUR).alias("x"))


def _hourly(s: SparkSession, d: str) -> DataFrame:
    n = _points(s, d).groupBy(F.col("unit").alias("session"), F.floor(F.col("t") / HOUR).alias("i")).agg(F.count("*").alias("n"))
    return n.select("session", "i", F.cos("n").alias("re"), F.sin("n").alias("im"))


_add("p01_phase_at_events", lambda s, d: tl.phase_at_events(_unit_points(s, d), _hourly(s, d)).withColumn("hour", F.floor("x")), "session seq hour ~phase",
     f"SELECT p.session, seq, t // {HOUR} AS hour, atan2(a.im + f * (b.im - a.im), a.re + f * (b.re - a.re)) AS phase FROM (SELECT unit AS session, seq, t, t / {HOUR}::DOUBLE - t // {HOUR} AS f FROM pt) p LEFT JOIN hs a ON a.session = p.session AND a.i = t // {HOUR} LEFT JOIN hs b ON b.session = p.session AND b.i = t // {HOUR} + 1", MICRO_SQL + HOURLY)
_add("g14_inter_trial_phase", lambda s, d: al.phase_locking(_hourly(s, d).withColumn("i", F.col("i") % 24).withColumn("phase", F.atan2("im", "re")), ["i"], "phase"), "i n ~resultant", "SELECT i % 24 AS i, count(*) AS n, sqrt(avg(re) ^ 2 + avg(im) ^ 2) AS resultant FROM hs GROUP BY 1", MICRO_SQL + HOURLY)
_add("g16_exemplars", lambda s, d: tl.exemplars(table(s, d, "events"), ["user_id"], "value", "event_id", 0.75), "user_id ~quantile event_id ~value",
     "SELECT user_id, q AS quantile, event_id, value FROM (SELECT e.*, q, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - q), event_id) AS k FROM events e JOIN (SELECT user_id, quantile_cont(value, 0.75) AS q FROM events GROUP BY 1) USING (user_id) WHERE value IS NOT NULL) WHERE k = 1")
_add("m16_coefficient_summary", lambda s, d: tl.coefficient_summary(ve.long_form(table(s, d, "embeddings").withColumn("fold", F.col("vec_id") % 5), "fold", "embedding").groupBy("unit", "fold").agg(F.avg("x").alias("coefficient")), "unit"), "unit n_folds ~mean n_positive ~percentile candidate",
     "SELECT *, (rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2 - 0.5) / count(*) OVER () AS percentile, n_folds = 5 AND mean > 0 AND n_positive >= 4 AS candidate FROM (SELECT unit, count(*) AS n_folds, avg(c) AS mean, count(*) FILTER (WHERE c > 0) AS n_positive FROM (SELECT unit, vec_id % 5 AS fold, avg(x) AS c FROM lv GROUP BY 1, 2) GROUP BY 1)", LONG)


# Models from cross products: held against numpy in the tests.
def _folded(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").withColumn("fold", F.col("vec_id") % 5)


def _lagged_days(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR).alias("i")).agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return tl.lagged(e.withColumn("part", F.floor(F.col("i") / 168)), ["part"], ["i"], ["a", "b"], [1, 2]).withColumn("x", F.array("a", "a_lag1", "a_lag2", "b_lag1", "b_lag2"))


QUERIES["m02_ridge"] = lambda s, d: li.ridge(_folded(s, d), "embedding", list(range(8)), list(range(32, 36)), 0.01)
QUERIES["m03_block_cv"] = lambda s, d: li.block_cv(_folded(s, d), "embedding", "fold", list(range(32)), list(range(32, 64)), 0.01)
QUERIES["m06_granger"] = lambda s, d: li.granger(_lagged_days(s, d), "x", 0, [1, 2], [3, 4])
QUERIES["m07_pca"] = lambda s, d: li.pca(_folded(s, d), "embedding").drop("loadings")
QUERIES["m09_cca"] = lambda s, d: li.cca(_folded(s, d), "embedding", list(range(16)), list(range(32, 48)))


# Streams: the table is read as a stream to its end.
def _stream(s: SparkSession, d: str) -> DataFrame:
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern may name a file or a folder


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.unix_micros("t"))


_add("x01_live_trials", lambda s, d: live.run_to_end(live.live_trials(_micros(_log_of(_stream(s, d))))), "session trial block side n_outcomes outcome note",
     "SELECT session, trial, coalesce(block, 0) AS block, side, n_outcomes, outcome, note FROM (SELECT *, max(trial) OVER (PARTITION BY session) AS m FROM asm) WHERE trial < m", LOG)
_add("x02_live_counters", lambda s, d: live.run_to_end(live.live_counters(_micros(trials_of(_stream(s, d)).where("valid")))), "session seq consecutive_rewards consecutive_omissions renewal_rewards renewal_omissions negative_value value n_late",
     "SELECT *, -negative_value AS value, 0 AS n_late FROM counters", COUNTERS)
STATES = "consecutive_rewards consecutive_omissions renewal_rewards renewal_omissions negative_value"
_add("c06_decision_table", lambda s, d: de.decision_table(trials(s, d)), f"session seq {STATES}",
     "SELECT session, seq, " + ", ".join(f"CAST(coalesce(first_value(c.{c} IGNORE NULLS) OVER w, {after}) AS BIGINT) AS {c}" for c, after in zip(STATES.split(), ["max(e.r) OVER s", "max(e.o) OVER s", "max(e.rr) OVER s", "max(e.ro) OVER s", "max(e.nv) OVER s"], strict=True))
     + " FROM trials LEFT JOIN counters c USING (session, seq) LEFT JOIN ends e USING (session) WINDOW w AS (PARTITION BY session ORDER BY trials.t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), s AS (PARTITION BY session)",
     COUNTERS + """, ends AS (SELECT session, CASE WHEN reward = 1 THEN n ELSE 0 END AS r, CASE WHEN reward = 0 THEN n ELSE 0 END AS o, CASE WHEN reward = 1 THEN n ELSE renewal_rewards END AS rr, CASE WHEN reward = 0 THEN n ELSE renewal_omissions END AS ro, negative_value + 1 - 2 * reward AS nv
  FROM (SELECT *, max(rn) OVER (PARTITION BY session) AS m FROM counters) WHERE rn = m)""")  # fmt: skip
EXPLORE = RUNS + """, x0 AS (SELECT *, CASE WHEN lag(action) OVER (PARTITION BY session, block_run ORDER BY t, seq) IS DISTINCT FROM action THEN 1 ELSE 0 END AS nw FROM runs WHERE valid),
x1 AS (SELECT *, sum(nw) OVER (PARTITION BY session, block_run ORDER BY t, seq) AS run FROM x0),
x2 AS (SELECT session, block_run, run, count(*) AS n, first(correct ORDER BY t, seq) AS f, last(correct * reward ORDER BY t, seq) AS p FROM x1 GROUP BY 1, 2, 3),
explored AS (SELECT session, block_run, run, n, coalesce(lag(p) OVER w = 1, false) AND n <= 5 AND coalesce(lead(f) OVER w = 1, false) AS explore FROM x2 WINDOW w AS (PARTITION BY session, block_run ORDER BY run))"""
_add("c08_explore_runs", lambda s, d: de.explore_runs(trials(s, d)), "session block_run run n explore", "SELECT * FROM explored", EXPLORE)
_add("a05_explore_counts", lambda s, d: de.explore_counts(de.explore_runs(trials(s, d))), "session block_run n_runs n_trials", "SELECT session, block_run, count(*) FILTER (WHERE explore) AS n_runs, CAST(coalesce(sum(n) FILTER (WHERE explore), 0) AS BIGINT) AS n_trials FROM explored GROUP BY 1, 2", EXPLORE)
_add("j23_purged_splits", lambda s, d: de.purged_splits(_points(s, d).withColumn("stop", F.col("t") + 6 * HOUR), "session", ["t", "seq"], "t", "stop"), "session seq fold role",
     f"""SELECT session, seq, CAST(fold AS INTEGER) AS fold, CASE WHEN role = 'train' AND row_number() OVER (PARTITION BY session, fold, role ORDER BY t DESC, seq DESC) <= ceil(count(*) OVER (PARTITION BY session, fold, role) / 5) THEN 'validation' ELSE role END AS role
FROM (SELECT p.*, f.fold, CASE WHEN own = f.fold THEN 'test' WHEN EXISTS (SELECT 1 FROM pn q WHERE q.session = p.session AND q.own = f.fold AND p.t < q.t + {6 * HOUR} AND p.t + {6 * HOUR} > q.t) THEN 'purged' ELSE 'train' END AS role FROM pn p, (SELECT unnest(range(5)) AS fold) f)""",
     MICRO_SQL + ", pn AS (SELECT *, ntile(5) OVER (PARTITION BY session ORDER BY t, seq) - 1 AS own FROM pt)")
