"""SQL twins: planning, batches, votes, probabilities, resampling."""

from __future__ import annotations

from .sql import HOURS, STUDY

PLAN = f"WITH {STUDY}, q AS (SELECT design_id, r, o, CAST(u AS DOUBLE) AS u, CAST(e AS DOUBLE) AS e, CAST(a AS DOUBLE) AS a, CAST(u / (u + e) AS DOUBLE) AS g, CAST(u / (u + a) AS DOUBLE) AS phi, CAST(r * o * 20 AS DOUBLE) AS n, 0.05 * (r * o * 20) + 2.0 * r + 3 AS cost FROM t), c AS (SELECT *, cost <= 20 AS budget, CASE WHEN o = 3 THEN NULL ELSE true END AS staffed FROM q), f AS (SELECT *, budget AND staffed AS feasible, g >= 0.95 AS meets FROM c)"
SUPPLY = "y AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS y FROM lineitem GROUP BY ALL), z AS (SELECT *, (l_suppkey // 5) || '/' || l_returnflag AS call FROM y)"
LAYOUT = "l AS (SELECT s_suppkey AS item, s_suppkey // 5 + 1 AS batch FROM supplier)"
KERNEL = "(VALUES ('item','same_item',1.0,'universe',1.5),('rater','all_items',{n},'error',0.3),('Call','same_batch',{n},'error',0.4),('Residual','same_item',{n},'error',0.6)) s(source, kernel, divisor, role, v)"
CONTRAST = "w AS (SELECT * FROM (VALUES ('contrast:1-7','contrast',1,1.0),('contrast:1-7','contrast',7,-1.0),('contrast:1-2','contrast',1,1.0),('contrast:1-2','contrast',2,-1.0)) w(target, target_kind, item, weight))"
ITEMS = "w AS (SELECT 'item:' || item AS target, 'absolute_item' AS target_kind, item, 1.0 AS weight FROM l)"
ALL = "w AS (SELECT 'aggregate:all' AS target, 'aggregate' AS target_kind, item, 1.0::DOUBLE / (SELECT count(*) FROM l) AS weight FROM l)"
CONTRACT = "b AS (SELECT target, target_kind, batch, sum(weight)::DOUBLE AS s, sum(weight * weight)::DOUBLE AS q FROM w JOIN l ON w.item = l.item GROUP BY ALL), k AS (SELECT target, target_kind, sum(q) AS same_item, sum(s) * sum(s) AS all_items, sum(s * s) AS same_batch FROM b GROUP BY ALL), x AS (SELECT target, target_kind, 'same_item' AS kernel, same_item AS contraction FROM k UNION ALL SELECT target, target_kind, 'all_items', all_items FROM k UNION ALL SELECT target, target_kind, 'same_batch', same_batch FROM k)"
TOTAL = "SELECT {id}target, target_kind, 'y' AS outcome, round(u, 6)::DOUBLE AS universe_variance, round(e, 6)::DOUBLE AS error_variance, round(sqrt(e), 6)::DOUBLE AS error_sd, round(u / (u + e), 6)::DOUBLE AS coefficient, CASE target_kind WHEN 'absolute_item' THEN 'Phi' ELSE 'contrast_reliability' END AS coefficient_name FROM t"
SUM = "t AS (SELECT {id}target, target_kind, sum(contraction / divisor * v) FILTER (role = 'universe') AS u, sum(contraction / divisor * v) FILTER (role = 'error') AS e FROM x JOIN {k} ON x.kernel = s.kernel GROUP BY ALL)"


def logit(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def ordinal(eta: str, cuts: list[float]) -> list[str]:
    f = [logit(f"{c} - ({eta})") for c in cuts]
    return [f[0], *[f"({b} - {a})" for a, b in zip(f, f[1:], strict=False)], f"(1 - {f[-1]})"]


P3 = ordinal("x", [-0.5, 0.7])
ETA = "e AS (SELECT event_id, user_id AS item, (event_id % 17) / 8.0 - 1 + (user_id % 5) / 4.0 AS x FROM events)"


def plurality(where: str, name: str) -> str:
    return f"""{name}n AS (SELECT user_id, event_type, count(*) AS votes FROM events {where} GROUP BY ALL),
{name} AS (SELECT user_id, event_type, votes, 1.0 / count(*) OVER (PARTITION BY user_id) AS share FROM {name}n WHERE (user_id, votes) IN (SELECT user_id, max(votes) FROM {name}n GROUP BY user_id))"""


def statements() -> dict[str, str]:
    p4, p2 = ordinal("eta", [-1.0, 0.25, 2.0]), ordinal("eta", [-0.6, 0.4])
    score = f"({P3[0]} + 2 * {P3[1]} + 4 * {P3[2]})"
    var = f"({P3[0]} * (1 - {score})^2 + {P3[1]} * (2 - {score})^2 + {P3[2]} * (4 - {score})^2)"
    half = lambda k: f"(SELECT item, avg({score}) AS m, avg({score})^2 + sum({var}) / count(*)^2 AS s FROM e WHERE event_id % 2 = {k} GROUP BY item)"
    rec = "r AS (SELECT o_custkey % 6 AS component, o_totalprice / 1000 AS value FROM orders)"
    q6 = lambda p: f"v[CAST(floor((n + 1) * {p}) AS BIGINT)] + ((n + 1) * {p} - floor((n + 1) * {p})) * (v[least(CAST(floor((n + 1) * {p}) AS BIGINT) + 1, n)] - v[CAST(floor((n + 1) * {p}) AS BIGINT)])"
    kinds = "CASE WHEN k < 6 THEN 'accepted' WHEN k = 6 THEN 'fit_error' WHEN k = 7 THEN 'simulation_error' WHEN k = 8 THEN 'numerically_refused' WHEN k = 9 THEN 'interval_unavailable' ELSE 'reliability_error' END"
    rate = lambda n, top: f"round({top} / attempted, 6) AS {n}_rate, round(sqrt(({top} / attempted) * (1 - {top} / attempted) / attempted), 6) AS {n}_mcse"
    sets = {"event_type": ["event_type"], "dow": ["dow"], "hour": ["hour"], "event_type:dow": ["event_type", "dow"], "event_type:hour": ["event_type", "hour"], "hour:dow": ["hour", "dow"]}
    pairs = sorted(sets, key=lambda s: (len(sets[s]), s))
    pair = lambda a, b: f"SELECT '{a}' AS source_a, '{b}' AS source_b, count(DISTINCT ({', '.join(k for k in ('event_type', 'hour', 'dow') if k in sets[a] + sets[b])})) AS pairs FROM h"
    catalog = [("hate_speech", "ordinal", 1), ("drug_review", "ordinal", 1), ("drug_review_4aspect", "ordinal", 4), ("mental_health_6flag", "binary", 6), ("mental_health_3group", "binary", 3), ("mental_health_nominal", "categorical", 1), ("mental_health_7L", "gaussian", 1), ("mental_health_3L", "gaussian", 1)]
    return {
        "source_pairs": f"WITH {HOURS} " + " UNION ALL ".join(pair(a, b) for i, a in enumerate(pairs) for b in pairs[i:]),
        "example_catalog": f"SELECT name, native_family, CAST(outcomes AS INTEGER) AS outcomes FROM (VALUES {', '.join(map(str, catalog))}) v(name, native_family, outcomes)",
        "plan_costs": f"{PLAN} SELECT design_id, n AS total_annotations, round(0.05 * n, 6)::DOUBLE AS cost_component_annotation, CAST(2 * r AS DOUBLE) AS cost_component_raters, CAST(3 AS DOUBLE) AS cost_component_setup, round(cost, 6)::DOUBLE AS total_cost, 'USD' AS currency FROM f",
        "plan_constraints": f"{PLAN} SELECT design_id, feasible, nullif(concat_ws('; ', CASE WHEN NOT budget THEN 'Failed: within_budget' END, CASE WHEN staffed IS NULL THEN 'Unknown: staffed' END), '') AS constraint_reason FROM f",
        "plan_minimum_cost": f"{PLAN} SELECT design_id, meets AS meets_target, feasible AND meets AS eligible, CASE WHEN (feasible AND meets) IS NOT NULL THEN (feasible AND meets) AND cost = (SELECT min(cost) FROM f WHERE feasible AND meets) END AS minimum_cost, CASE WHEN feasible THEN (SELECT count(*) + 1 FROM f b WHERE b.feasible AND b.cost < f.cost) ELSE 0 END AS cost_rank FROM f",
        "plan_pareto": f"{PLAN} SELECT design_id, feasible, CASE WHEN NOT feasible THEN false WHEN feasible THEN NOT EXISTS (SELECT 1 FROM f b WHERE b.feasible AND b.cost <= f.cost AND b.g >= f.g AND (b.cost < f.cost OR b.g > f.g)) END AS pareto FROM f",
        "plan_baseline": f"{PLAN}, b AS (SELECT * FROM f WHERE design_id = 1) SELECT f.design_id, round(f.cost - b.cost, 6)::DOUBLE + 0.0 AS extra_cost, round(b.e - f.e, 6) + 0.0 AS relative_error_reduction, round(b.a - f.a, 6) + 0.0 AS absolute_error_reduction, round(f.g - b.g, 6) + 0.0 AS \"Erho2_gain\", round(f.phi - b.phi, 6) + 0.0 AS \"Phi_gain\" FROM f, b",
        "plan_source_contributions": f"WITH {STUDY}, y AS (SELECT design_id, source, kind, CASE WHEN kind = 'universe' THEN v ELSE 0 END AS u, CASE WHEN kind = 'rel' THEN v * w ELSE 0 END AS e, CASE WHEN kind IN ('rel', 'abs') THEN v * w ELSE 0 END AS a FROM x) SELECT y.design_id, y.source, CASE y.kind WHEN 'universe' THEN 'universe' WHEN 'rel' THEN 'relative_and_absolute_error' ELSE 'absolute_error' END AS role, round(y.u, 6)::DOUBLE + 0.0 AS universe, round(y.e, 6)::DOUBLE AS relative_error, round(y.a, 6)::DOUBLE AS absolute_error, round(b.e - y.e, 6)::DOUBLE + 0.0 AS relative_error_reduction, round(b.a - y.a, 6)::DOUBLE + 0.0 AS absolute_error_reduction FROM y JOIN y b ON b.design_id = 1 AND b.source = y.source",
        "batch_inferred": "SELECT s_suppkey, (rn - 1) // 5 + 1 AS batch, (rn - 1) % 5 + 1 AS position FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier)",
        "batch_problems": "WITH i AS (SELECT l_suppkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) SELECT CAST((SELECT count(*) FROM i WHERE lo <> hi) AS BIGINT) AS varying_items, CAST(coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM i GROUP BY lo) WHERE n > 1), 0) AS BIGINT) AS tied_items",
        "batch_recorded": f"WITH {SUPPLY} SELECT call, l_suppkey, row_number() OVER (PARTITION BY call ORDER BY l_suppkey) AS position FROM z",
        "batch_audit": f"WITH {SUPPLY}, g AS (SELECT call, count(*) AS n, count(DISTINCT l_suppkey) AS items, count(DISTINCT l_returnflag) AS conditions, list_sort(list(DISTINCT l_suppkey)) AS members, min(l_returnflag) AS condition FROM z GROUP BY call), y2 AS (SELECT condition, list_sort(list(DISTINCT members)) AS layout FROM g GROUP BY condition) SELECT count(*) AS calls, count(DISTINCT members) AS batches, count(*) FILTER (conditions > 1) AS spanning, count(*) FILTER (n > items) AS repeated, count(*) FILTER (n > 5) AS oversized, count(*) FILTER (items < n) AS tied, max(n) AS largest, (SELECT count(DISTINCT layout) = 1 FROM y2) AS fixed_composition FROM g",
        "call_groups": f"WITH {SUPPLY} SELECT call, count(*) AS rows, count(DISTINCT l_suppkey) AS items, count(DISTINCT l_returnflag) AS conditions, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS composition FROM z GROUP BY call",
        "batch_eligibility": f"WITH {SUPPLY}, {LAYOUT}, c AS (SELECT count(*) = count(DISTINCT l_suppkey) * count(DISTINCT l_returnflag) AS ok FROM y), b AS (SELECT batch, count(*) AS n FROM l GROUP BY batch), s AS (SELECT min(n) = 5 AND max(n) = 5 AS equal, count(*) AS batches FROM b), v AS (SELECT CASE WHEN NOT ok THEN 'fixed call effects need a complete panel with one row per cell' WHEN NOT equal THEN 'not every batch holds the declared items' WHEN batches < 2 THEN 'there are fewer than two batches' END AS reason, batches FROM c, s) SELECT reason IS NULL AS modelled, reason, batches FROM v",
        "batch_item_reliability": f"WITH {LAYOUT}, {ITEMS}, {CONTRACT}, {SUM.format(id='', k=KERNEL.format(n='4.0'))} {TOTAL.format(id='')}",
        "batch_contrast": f"WITH {LAYOUT}, {CONTRAST}, {CONTRACT}, {SUM.format(id='', k=KERNEL.format(n='4.0'))} {TOTAL.format(id='')}",
        "batch_aggregate": f"WITH {LAYOUT}, {ALL}, {CONTRACT} SELECT target, source, x.kernel, role, round(contraction, 8)::DOUBLE AS contraction, CAST(divisor AS DOUBLE) AS divisor, round(contraction / divisor * v, 8)::DOUBLE AS variance FROM x JOIN {KERNEL.format(n='4.0')} ON x.kernel = s.kernel",
        "batch_dstudy": f"WITH {LAYOUT}, {CONTRAST}, {CONTRACT}, n AS (SELECT unnest([1, 2, 4, 8]) AS n), s AS (SELECT n AS design_id, source, kernel, CASE WHEN source = 'item' THEN 1.0 ELSE n END AS divisor, role, v FROM n, {KERNEL.format(n='1.0')}), {SUM.format(id='CAST(design_id AS BIGINT) AS design_id, ', k='s')} {TOTAL.format(id='design_id, ')}",
        "plurality_votes": f"WITH {plurality('', 'a')} SELECT user_id, event_type, votes, round(share, 6)::DOUBLE AS share FROM a",
        "decision_agreement": f"WITH {plurality('WHERE event_id % 2 = 0', 'a')}, {plurality('WHERE event_id % 2 = 1', 'b')}, i AS (SELECT DISTINCT user_id FROM a INTERSECT SELECT user_id FROM b), n AS (SELECT count(*) AS n FROM i), g AS (SELECT sum(a.share * b.share) AS s FROM a JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type), u AS (SELECT event_type, sum(share) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE user_id IN (SELECT user_id FROM i) GROUP BY event_type) SELECT round(coalesce((SELECT s FROM g), 0) / n, 6)::DOUBLE AS agreement, n AS items, round(1 - (SELECT sum((s / (2.0 * n))^2) FROM u, n), 6)::DOUBLE AS decision_diversity FROM n",
        "category_moments": f"WITH {ETA}, m AS (SELECT item, avg({P3[0]}) AS p1, avg({P3[1]}) AS p2, avg({P3[2]}) AS p3, sum(1 - {P3[0]}^2 - {P3[1]}^2 - {P3[2]}^2) / count(*)^2 AS noise FROM e GROUP BY item) SELECT item, round(p1, 6)::DOUBLE AS p1, round(p2, 6)::DOUBLE AS p2, round(p3, 6)::DOUBLE AS p3, round(p1^2 + p2^2 + p3^2 + noise, 6)::DOUBLE AS second FROM m",
        "score_ratio": f"""WITH {ETA}, j AS (SELECT a.m AS l, b.m AS r, a.m * b.m AS c, (a.s + b.s) / 2 AS s FROM {half(0)} a JOIN {half(1)} b ON a.item = b.item), k AS (SELECT avg(l) AS ml, avg(r) AS mr, avg(c) - avg(l) * avg(r) AS sig, avg(s) - ((avg(l) + avg(r)) / 2)^2 AS t, (avg(l) + avg(r)) / 2 AS mid FROM j),
i AS (SELECT (l * (-mr * t + sig * mid) + r * (-ml * t + sig * mid) + c * t - s * sig) / t^2 AS i, sig, t FROM j, k)
SELECT round(any_value(sig), 6) + 0.0 AS signal_variance, round(any_value(t), 6) + 0.0 AS total_variance, round(any_value(sig) / any_value(t), 6) + 0.0 AS raw_estimate, round(sqrt(var_samp(i) / count(*)), 6) AS mc_se FROM i""",
        "replicate_agreement": "SELECT l_returnflag, count(*) AS cells, round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement FROM (SELECT l_suppkey, l_linenumber, l_returnflag, count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY ALL) GROUP BY l_returnflag",
        "binary_probabilities": f"SELECT id, round({logit('eta')}, 9)::DOUBLE AS p FROM (SELECT i AS id, (i - 20) / 4.0 AS eta FROM range(41) t(i))",
        "ordinal_probabilities_logit": f"SELECT id, {', '.join(f'round({p}, 9)::DOUBLE AS p{i + 1}' for i, p in enumerate(p4))} FROM (SELECT i AS id, (i - 20) / 4.0 AS eta FROM range(41) t(i))",
        "softmax_probabilities": "SELECT id, round(1 / (1 + exp(a) + exp(b)), 9)::DOUBLE AS p1, round(exp(a) / (1 + exp(a) + exp(b)), 9)::DOUBLE AS p2, round(exp(b) / (1 + exp(a) + exp(b)), 9)::DOUBLE AS p3 FROM (SELECT i AS id, (i - 20) / 4.0 AS a, (i % 7) / 2.0 AS b FROM range(41) t(i))",
        "inverse_cdf_labels": f"SELECT event_id, CASE WHEN u < {p2[0]} THEN 'low' WHEN u < {p2[0]} + {p2[1]} THEN 'mid' ELSE 'high' END AS label FROM (SELECT event_id, (event_id * 7919 % 10007) / 10007.0 AS u, (user_id % 9) / 3.0 - 1 AS eta FROM events)",
        "bootstrap_resample": "WITH n AS (SELECT count(*) AS n FROM supplier), d AS (SELECT i // n + 1 AS attempt, i % n AS position, i * 7919 % n + 1 AS item FROM n, (SELECT unnest(range(3 * (SELECT n FROM n))) AS i)) SELECT attempt, s_nationkey, count(*) AS n, CAST(sum(position) AS BIGINT) AS positions FROM d JOIN supplier ON item = s_suppkey GROUP BY ALL",
        "percentile_interval_type6": f"WITH {rec}, g AS (SELECT component, list_sort(list(value)) AS v, count(*) AS n, stddev_samp(value) AS sd FROM r GROUP BY component) SELECT component, round(sd, 3) AS se, round({q6('0.05::DOUBLE')}, 3) AS lower, round({q6('0.95::DOUBLE')}, 3) AS upper, n AS finite FROM g",
        "jackknife_acceleration": f"WITH {rec}, m AS (SELECT component, avg(value) AS m FROM r GROUP BY component) SELECT r.component, round(sum((m - value)^3) / (6 * sum((m - value)^2)^1.5), 7) + 0.0 AS acceleration FROM r JOIN m ON r.component = m.component GROUP BY r.component",
        "pilot_summary": f"WITH o AS (SELECT o_custkey % 4 AS design_id, {kinds} AS status, o_totalprice / 500000 AS width FROM (SELECT *, o_orderkey % 11 AS k FROM orders)), g AS (SELECT design_id, count(*) AS attempted, count(*) FILTER (status IN ('accepted', 'interval_unavailable')) AS accepted, count(*) FILTER (status = 'fit_error') AS preparation_or_fit_errors, count(*) FILTER (status = 'simulation_error') AS simulation_errors, count(*) FILTER (status = 'numerically_refused') AS refused, count(*) FILTER (status = 'reliability_error') AS reliability_errors, count(*) FILTER (status = 'accepted') AS interval_available, count(*) FILTER (status = 'interval_unavailable') AS interval_unavailable, round(avg(width) FILTER (status = 'accepted'), 6) AS mean_width_given_interval, round(stddev_samp(width) FILTER (status = 'accepted') / sqrt(count(*) FILTER (status = 'accepted')), 6) AS mean_width_mcse_given_interval, count(*) FILTER (status = 'accepted' AND width <= 0.3) AS precision_successes FROM o GROUP BY design_id) SELECT *, {rate('acceptance', 'accepted')}, {rate('refusal', 'refused')}, {rate('error', '(preparation_or_fit_errors + simulation_errors + reliability_errors)')}, {rate('interval', 'interval_available')}, 0.3::DOUBLE AS width_target, {rate('precision_success', 'precision_successes')} FROM g",
    }
