"""SQL twins: audit, codings, strata, reliability."""

from __future__ import annotations

from itertools import combinations

PRICE = """p AS (SELECT p_brand, l_returnflag, l_linestatus, avg(p_retailprice) AS price, avg(l_quantity) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
AXES = ["p_brand", "l_returnflag", "l_linestatus"]
HOURS = "h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, value FROM events)"
CELLS = f"WITH {HOURS}, c AS (SELECT event_type, hour, dow, count(*) AS n FROM h GROUP BY ALL)"
DOCS = "d AS (SELECT d.*, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def subsets(axes: list[str]):
    return [(sum(1 << axes.index(a) for a in s), s) for k in range(len(axes) + 1) for s in combinations(axes, k)]


def strata_cte(outcomes: list[str], axes: list[str], panel: str = "p") -> str:
    """s(mask, row, col, df, sscp): explicit group-bys of every subset and inclusion-exclusion written out."""
    pairs = [(a, b) for i, a in enumerate(outcomes) for b in outcomes[i:]]
    out = [f"z AS (SELECT {', '.join(axes)}, {', '.join(f'{o} - avg({o}) OVER () AS {o}' for o in outcomes)} FROM {panel})"]
    out.append(f"k AS (SELECT {', '.join(f'count(DISTINCT {a}) AS n{j}' for j, a in enumerate(axes))} FROM {panel})")
    for mask, sub in subsets(axes):
        group = f"GROUP BY {', '.join(sub)}" if sub else ""
        out.append(f"g{mask} AS (SELECT {', '.join(f'sum(n * a{i} * b{i}) AS q{i}' for i in range(len(pairs)))} FROM (SELECT count(*) AS n, {', '.join(f'avg({a}) AS a{i}, avg({b}) AS b{i}' for i, (a, b) in enumerate(pairs))} FROM z {group}))")
    rows = []
    for mask, sub in subsets(axes):
        df = " * ".join(f"(n{axes.index(a)} - 1)" for a in sub) or "1"
        inner = [(m, (-1) ** (len(sub) - len(t))) for m, t in subsets(axes) if set(t) <= set(sub)]
        for i, (a, b) in enumerate(pairs):
            total = " ".join(f"{'+' if s > 0 else '-'} (SELECT q{i} FROM g{m})" for m, s in inner)
            rows.append(f"SELECT {mask} AS mask, '{a}' AS row, '{b}' AS col, {df} AS df, {total} AS sscp FROM k")
    out.append("s AS (" + " UNION ALL ".join(rows) + ")")
    return ", ".join(out)


def moments_cte(outcomes: list[str], axes: list[str], panel: str = "p") -> str:
    """m(mask, source, row, col, component): back-substitution from the saturated stratum, written out."""
    full = (1 << len(axes)) - 1
    pairs = [(a, b) for i, a in enumerate(outcomes) for b in outcomes[i:]]
    rows = []
    for mask, sub in subsets(axes):
        if not mask:
            continue
        outside = " * ".join(f"n{j}" for j, a in enumerate(axes) if a not in sub) or "1"
        above = [(m, (-1) ** (len(t) - len(sub))) for m, t in subsets(axes) if set(sub) <= set(t)]
        name = "Residual" if mask == full else ":".join(sub)
        for a, b in pairs:
            total = " ".join(f"{'+' if s > 0 else '-'} (SELECT sscp / df FROM s WHERE mask = {m} AND row = '{a}' AND col = '{b}')" for m, s in above)
            rows.append(f"SELECT {mask} AS mask, '{name}' AS source, '{a}' AS row, '{b}' AS col, ({total}) / ({outside}) AS component FROM k")
    return strata_cte(outcomes, axes, panel) + ", m AS (" + " UNION ALL ".join(rows) + ")"


def flagship(universe: list[str], relative: dict[str, str], absolute: dict[str, str], outcome: str = "component") -> str:
    pick = lambda s: f"(SELECT greatest({outcome}, 0) FROM m WHERE source = '{s}' AND row = 'price' AND col = 'price')"
    part = lambda w: " + ".join(f"{pick(s)} / ({x})" for s, x in w.items())
    u = " + ".join(pick(s) if ":" not in s else f"{pick(s)} / 2" for s in universe)
    return f"SELECT {u} AS u, {part(relative)} AS e, {part(absolute)} AS a"


REL = {"p_brand:l_returnflag": "3", "p_brand:l_linestatus": "2", "Residual": "6"}
ABS = REL | {"l_returnflag": "3", "l_linestatus": "2", "l_returnflag:l_linestatus": "6"}
ONE = f"WITH {PRICE}, {moments_cte(['price'], AXES)}"
JOINT = f"WITH {PRICE}, {moments_cte(['price', 'quantity'], AXES)}"
COEF = "round(u / (u + e), {k}) + 0.0 AS \"Erho2\", round(u / (u + a), {k}) + 0.0 AS \"Phi\""

GOLD = "(VALUES ('item',2.0,0,0,'universe'),('rater',0.4,1,0,'abs'),('occasion',0.2,0,1,'abs'),('item:rater',1.2,1,0,'rel'),('item:occasion',0.1,0,1,'rel'),('rater:occasion',0.3,1,1,'abs'),('Residual',0.6,1,1,'rel')) g(source, v, hr, ho, kind)"
ALLOC = "(SELECT row_number() OVER (ORDER BY o, r) AS design_id, r, o FROM (SELECT unnest([1,2,3,4]) AS r), (SELECT unnest([1,2,3]) AS o))"
ROLES = "(VALUES (1,'item',0,0,'universe'),(2,'rater',1,0,'abs'),(4,'occasion',0,1,'abs'),(3,'item:rater',1,0,'rel'),(5,'item:occasion',0,1,'rel'),(6,'rater:occasion',1,1,'abs'),(7,'Residual',1,1,'rel')) v(mask_bits, source, hr, ho, kind)"
STUDY = f"""{PRICE}, {moments_cte(['price'], AXES)}, gold AS (SELECT v.source, greatest(component, 0) AS v, hr, ho, kind FROM m JOIN {ROLES} ON m.mask = v.mask_bits),
x AS (SELECT design_id, r, o, source, v, kind, 1.0 / ((CASE WHEN hr = 1 THEN r ELSE 1 END) * (CASE WHEN ho = 1 THEN o ELSE 1 END)) AS w FROM {ALLOC} a, gold),
t AS (SELECT design_id, any_value(r) AS r, any_value(o) AS o, sum(CASE WHEN kind = 'universe' THEN v ELSE 0 END) AS u,
  sum(CASE WHEN kind = 'rel' THEN v * w ELSE 0 END) AS e, sum(CASE WHEN kind IN ('rel', 'abs') THEN v * w ELSE 0 END) AS a FROM x GROUP BY design_id)"""


def _preflight(cells: str, axes: list[str], groups: list[list[str]], varies: str, axis_limit: bool = True) -> str:
    expected = " * ".join(f"count(DISTINCT {a})" for a in axes)
    sizes = " AND ".join(f"count(DISTINCT ({', '.join(g)})) >= 2" for g in groups)
    return f"""{cells}, f AS (SELECT min(n) = 1 AND max(n) = 1 AS rep, {sizes} AS grp, count(*) = {expected} AS comp, max(n) = 1 AS single FROM c)
SELECT 'declared_replication' AS "check", rep AS passed FROM f UNION ALL SELECT 'repeated_source_groups', grp FROM f UNION ALL SELECT 'complete_coded_panel', comp FROM f
UNION ALL SELECT 'one_row_per_cell', single FROM f UNION ALL SELECT 'factorial_strata_limit', {str(axis_limit).lower()} UNION ALL SELECT 'outcome_variation', ({varies})"""


def _deviance() -> str:
    at = {"p_brand": 400.0, "l_returnflag": 5.0, "l_linestatus": 5.0, "p_brand:l_returnflag": 20.0, "p_brand:l_linestatus": 20.0, "l_returnflag:l_linestatus": 2.0}
    lam = []
    for mask, sub in subsets(AXES):
        terms = ["60.0"] + [f"{v} * " + (" * ".join(f"n{j}" for j, a in enumerate(AXES) if a not in s.split(":")) or "1") for s, v in at.items() if set(sub) <= set(s.split(":"))]
        lam.append(f"WHEN {mask} THEN {' + '.join(terms)}")
    return f"""WITH {PRICE}, {strata_cte(['price'], AXES)}, l AS (SELECT mask, df, sscp, n0 * n1 * n2 AS n, CASE mask {' '.join(lam)} END AS lam FROM s, k)
SELECT 'REML' AS estimator, round((max(n) - 1) * ln(2 * pi()) + ln(max(n)) + sum(df * ln(lam) + sscp / lam), 4) + 0.0 AS deviance FROM l WHERE mask <> 0
UNION ALL SELECT 'ML', round(max(n) * ln(2 * pi()) + sum(df * ln(lam) + CASE WHEN mask = 0 THEN 0 ELSE sscp / lam END), 4) + 0.0 FROM l"""


def statements() -> dict[str, str]:
    l4 = ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    supply = {"l_suppkey": ["l_suppkey"], "l_linenumber": ["l_linenumber"], "l_returnflag": ["l_returnflag"], "l_linenumber:l_returnflag": ["l_linenumber", "l_returnflag"], "l_suppkey:l_linenumber": ["l_suppkey", "l_linenumber"], "l_suppkey:l_returnflag": ["l_suppkey", "l_returnflag"]}
    gram = lambda a, b, keys: f"SELECT '{a}' AS source_a, '{b}' AS source_b, CAST(sum(n * n) AS DOUBLE) AS gram FROM (SELECT count(*) AS n FROM w GROUP BY {keys})"
    coverage = lambda name, keys: f"SELECT '{name}' AS variable, event_type AS category, count(*) AS groups_with_category, (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM h)) AS groups, round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM h)), 6) + 0.0 AS coverage FROM (SELECT DISTINCT {keys}, event_type FROM h) GROUP BY event_type"
    novar = lambda name, keys: f"SELECT '{name}' AS variable, count(*) AS groups, CAST(sum(CASE WHEN q <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS no_variation, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single_row FROM (SELECT count(*) AS n, count(DISTINCT quality) AS q FROM d GROUP BY {keys})"
    emb = "p AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS hi, CAST((i - 1) % 8 AS INTEGER) AS lo, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
    u, rel, ab = ["p_brand"], REL, ABS
    fixed = flagship(["p_brand", "p_brand:l_linestatus"], {k: v for k, v in rel.items() if k != "p_brand:l_linestatus"}, {k: v for k, v in ab.items() if k not in ("p_brand:l_linestatus", "l_linestatus")})
    comp = "c AS (SELECT source, 'price' AS row, 'price' AS col, sum(component * (CASE row WHEN 'price' THEN 1 ELSE 2 END) * (CASE col WHEN 'price' THEN 1 ELSE 2 END) * (CASE WHEN row = col THEN 1 ELSE 2 END)) AS component FROM m GROUP BY source)"
    nested = "(VALUES ('person',1.0,0,0,'u'),('question',0.2,0,1,'a'),('item:question',0.1,1,1,'a'),('person:question',0.3,0,1,'r'),('Residual',0.8,1,1,'r')) g(source, v, hi, hq, kind)"
    out = {
        "panel_completeness": f"{CELLS} SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS observed_cells, count(DISTINCT event_type) * count(DISTINCT hour) * count(DISTINCT dow) AS expected_cells, min(n) AS min_rows, max(n) AS max_rows, count(*) = count(DISTINCT event_type) * count(DISTINCT hour) * count(DISTINCT dow) AND min(n) = 1 AND max(n) = 1 AS balanced FROM c",
        "panel_cell_status": f"{CELLS}, e AS (SELECT count(DISTINCT event_type) * count(DISTINCT hour) * count(DISTINCT dow) - count(*) AS n FROM c), v AS (SELECT 'complete' AS status, count(*) FILTER (n = 1) AS n FROM c UNION ALL SELECT 'under_replicated', count(*) FILTER (n < 1) FROM c UNION ALL SELECT 'over_replicated', count(*) FILTER (n > 1) FROM c UNION ALL SELECT 'missing', n FROM e) SELECT status, CAST(n AS DOUBLE) AS cell_count, CAST(n AS VARCHAR) AS cell_count_exact FROM v",
        "panel_missing_cells": f"WITH {HOURS} SELECT event_type, hour, dow FROM (SELECT DISTINCT event_type FROM h), (SELECT DISTINCT hour FROM h), (SELECT DISTINCT dow FROM h) EXCEPT SELECT event_type, hour, dow FROM h ORDER BY event_type, hour, dow LIMIT 20",
        "panel_replication_issues": f"{CELLS} SELECT event_type, hour, dow, n AS rows FROM c WHERE n <> 1 ORDER BY event_type, hour, dow LIMIT 20",
        "level_counts": " UNION ALL ".join(f"SELECT '{v}' AS variable, count(DISTINCT {v}) AS levels FROM lineitem" for v in l4),
        "source_group_counts": " UNION ALL ".join(f"SELECT '{s}' AS source, count(DISTINCT ({', '.join(k)})) AS observed_groups, CAST(1 AS BIGINT) AS predictor_dimensions, count(DISTINCT ({', '.join(k)})) AS random_dimension, CAST(1 AS BIGINT) AS covariance_parameters FROM lineitem" for s, k in supply.items()),
        "kernel_gram": "WITH w AS (SELECT DISTINCT user_id, event_type FROM events) " + " UNION ALL ".join([gram("event_type", "event_type", "event_type"), gram("event_type", "user_id", "event_type, user_id"), gram("user_id", "user_id", "user_id")]),
        "preflight_checks": _preflight(f"WITH {PRICE}, c AS (SELECT p_brand, l_returnflag, l_linestatus, count(*) AS n FROM p GROUP BY ALL)", AXES, [list(s) for _, s in subsets(AXES) if s and len(s) < 3], "SELECT count(DISTINCT price) > 1 AND count(DISTINCT quantity) > 1 FROM p"),
        "preflight_incomplete": _preflight(CELLS, ["event_type", "hour", "dow"], [list(s) for _, s in subsets(["event_type", "hour", "dow"]) if s and len(s) < 3], "SELECT count(DISTINCT value) > 1 FROM h"),
        "outcome_profile_numeric": "SELECT count(value) AS n, count(DISTINCT value) AS n_distinct, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM events",
        "outcome_profile_categories": f"WITH {DOCS} SELECT category, count(lang) AS n, round(count(lang) / (SELECT count(*) FROM d), 6) + 0.0 AS proportion FROM (SELECT unnest(['de','en','es','fr','it']) AS category) LEFT JOIN d ON lang = category GROUP BY category",
        "category_coverage": f"WITH {HOURS} {coverage('hour', 'hour')} UNION ALL {coverage('hour:dow', 'hour, dow')}",
        "no_variation_groups": f"WITH {DOCS} {novar('source', 'source')} UNION ALL {novar('source:lang', 'source, lang')}",
        "null_counts": "SELECT count(*) - count(user_id) AS user_id, count(*) - count(event_type) AS event_type, count(*) FILTER (value IS NULL OR isnan(value)) AS value FROM events",
        "encode_ordinal": "SELECT o_orderkey, CAST(list_position(['5-LOW','4-NOT SPECIFIED','3-MEDIUM','2-HIGH','1-URGENT'], upper(trim(o_orderpriority))) AS INTEGER) AS code FROM orders",
        "encode_binary": "SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type IS NOT NULL THEN 0 END AS INTEGER) AS code FROM events",
        "encode_nominal": "SELECT event_id, event_type AS label FROM events",
        "working_score_map": "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS INTEGER) AS score FROM orders",
        "flag_groups": "SELECT o_orderkey, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS pressing, CAST(o_orderstatus = 'O' OR o_totalprice > 100000 AS INTEGER) AS open_or_large FROM orders",
        "strata_ss": f"WITH {PRICE}, {strata_cte(['price'], AXES)} SELECT CAST(mask AS INTEGER) AS mask, CAST(df AS BIGINT) AS df, round(sscp, 4) + 0.0 AS sscp FROM s",
        "strata_sscp_joint": f"WITH {PRICE}, {strata_cte(['price', 'quantity'], AXES)} SELECT CAST(mask AS INTEGER) AS mask, row, col, CAST(df AS BIGINT) AS df, round(sscp, 4) + 0.0 AS sscp FROM s",
        "moment_components": f"{ONE} SELECT CAST(mask AS INTEGER) AS mask, source, row, col, round(component, 5) + 0.0 AS component FROM m",
        "moment_components_joint": f"{JOINT} SELECT CAST(mask AS INTEGER) AS mask, source, row, col, round(component, 5) + 0.0 AS component FROM m",
        "moment_components_embeddings": f"WITH {emb}, {moments_cte(['v'], ['vec_id', 'hi', 'lo'])} SELECT CAST(mask AS INTEGER) AS mask, source, row, col, round(component, 8) + 0.0 AS component FROM m",
        "gaussian_deviance_given_components": _deviance(),
        "component_correlations": f"{JOINT}, d AS (SELECT source, row AS v, component AS var FROM m WHERE row = col) SELECT m.source, m.row, m.col, round(CASE WHEN a.var > 0 AND b.var > 0 THEN m.component / sqrt(CASE WHEN a.var > 0 AND b.var > 0 THEN a.var * b.var ELSE 1 END) END, 5) + 0.0 AS correlation FROM m JOIN d a ON m.source = a.source AND m.row = a.v JOIN d b ON m.source = b.source AND m.col = b.v",
        "reliability_g_phi": f"{ONE}, f AS ({flagship(u, rel, ab)}) SELECT 'price' AS outcome, round(u, 5) + 0.0 AS universe_variance, round(e, 5) + 0.0 AS relative_error, round(a, 5) + 0.0 AS absolute_error, {COEF.format(k=5)} FROM f",
        "reliability_fixed_facet": f"{ONE}, f AS ({fixed}) SELECT 'price' AS outcome, {COEF.format(k=5)} FROM f",
        "reliability_composite": f"{JOINT}, {comp}, f AS ({flagship(u, rel, ab).replace('FROM m', 'FROM c')}) SELECT 'composite' AS kind, 'composite' AS outcome, {COEF.format(k=5)} FROM f",
        "source_weights": f"WITH a AS (SELECT row_number() OVER (ORDER BY o, r) AS design_id, r, o FROM (SELECT unnest([2,4]) AS r), (SELECT unnest([1,2]) AS o)), x AS (SELECT design_id, source, kind, 1.0 / ((CASE WHEN hr = 1 THEN r ELSE 1 END) * (CASE WHEN ho = 1 THEN o ELSE 1 END)) AS w FROM a, {GOLD}) SELECT design_id, source, CASE WHEN kind = 'universe' THEN 1.0 ELSE 0.0 END::DOUBLE AS universe, round(CASE WHEN kind = 'rel' THEN w ELSE 0 END, 6)::DOUBLE AS relative, round(CASE WHEN kind IN ('rel', 'abs') THEN w ELSE 0 END, 6)::DOUBLE AS absolute, CASE kind WHEN 'universe' THEN 'universe' WHEN 'rel' THEN 'relative_and_absolute_error' ELSE 'absolute_error' END AS role FROM x",
        "dstudy_grid": f"WITH {STUDY} SELECT design_id, CAST(r AS BIGINT) AS allocation_rater, CAST(o AS BIGINT) AS allocation_occasion, round(u / (u + e), 6)::DOUBLE AS \"Erho2\", round(u / (u + a), 6)::DOUBLE AS \"Phi\", CAST(r * o AS DOUBLE) AS measurements_per_object, r > 2 OR o > 2 AS extrapolated FROM t",
        "dstudy_flagship": f"""{ONE}, g AS (SELECT row_number() OVER (ORDER BY l_linestatus, l_returnflag) AS design_id, l_returnflag, l_linestatus FROM (SELECT unnest([1,2,3,6]) AS l_returnflag), (SELECT unnest([1,2,4]) AS l_linestatus)),
w AS (SELECT design_id, l_returnflag AS f, l_linestatus AS s, source, greatest(component, 0) AS v, CASE source WHEN 'p_brand' THEN 1 WHEN 'l_returnflag' THEN 1.0 / l_returnflag WHEN 'p_brand:l_returnflag' THEN 1.0 / l_returnflag WHEN 'l_linestatus' THEN 1.0 / l_linestatus WHEN 'p_brand:l_linestatus' THEN 1.0 / l_linestatus ELSE 1.0 / (l_returnflag * l_linestatus) END AS w FROM g, m),
t AS (SELECT design_id, any_value(f) AS f, any_value(s) AS s, sum(v * w) FILTER (source = 'p_brand') AS u, sum(v * w) FILTER (source IN ('p_brand:l_returnflag', 'p_brand:l_linestatus', 'Residual')) AS e, sum(v * w) FILTER (source <> 'p_brand') AS a FROM w GROUP BY design_id)
SELECT design_id, CAST(f AS BIGINT) AS l_returnflag, CAST(s AS BIGINT) AS l_linestatus, {COEF.format(k=5)} FROM t""",
        "dstudy_target": f"WITH {STUDY}, q AS (SELECT design_id, u / (u + e) AS c, r * o AS n FROM t) SELECT design_id, round(c, 6)::DOUBLE AS estimate, c >= 0.95 AS meets_target, c >= 0.95 AND n = (SELECT min(n) FROM q WHERE c >= 0.95) AS fewest_measurements FROM q",
        "dstudy_nested": f"WITH a AS (SELECT row_number() OVER (ORDER BY q, i) AS design_id, i, q FROM (SELECT unnest([3,6]) AS i), (SELECT unnest([2,4]) AS q)), x AS (SELECT design_id, i, q, kind, v / ((CASE WHEN hi = 1 THEN i ELSE 1 END) * (CASE WHEN hq = 1 THEN q ELSE 1 END)) AS p FROM a, {nested}), t AS (SELECT design_id, any_value(i) AS i, any_value(q) AS q, sum(p) FILTER (kind = 'u') AS u, sum(p) FILTER (kind = 'r') AS e, sum(p) FILTER (kind IN ('r', 'a')) AS a FROM x GROUP BY design_id) SELECT design_id, CAST(i AS BIGINT) AS item, CAST(q AS BIGINT) AS question, round(u / (u + e), 6)::DOUBLE AS \"Erho2\", round(u / (u + a), 6)::DOUBLE AS \"Phi\" FROM t",
        "coefficient_interval_logit": f"WITH {STUDY}, q AS (SELECT design_id, CAST(u / (u + e) AS DOUBLE) AS c, 0.05 / r AS se FROM t), i AS (SELECT design_id, ln(c / (1 - c)) AS eta, 1.959963984540054 * se / (c * (1 - c)) AS h FROM q) SELECT design_id, round(1 / (1 + exp(-(eta - h))), 6) AS lower, round(1 / (1 + exp(-(eta + h))), 6) AS upper FROM i",
    }
    return out
