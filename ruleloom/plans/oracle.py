"""The catalog's queries as plain SQL over the same tables, written from the definitions for another engine.

Each statement is a chain of common table expressions. Rule tables have the columns bag_id, level, rank, ant (list), con,
support, confidence, chi2 (null where undefined).
"""

from __future__ import annotations

import math

from ruleloom.plans import catalog as c

Ctes = list[tuple[str, str]]


def _statement(ctes: Ctes, final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{final}" if ctes else final


def _hash(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT)"


def _draw(key: str, salt: str) -> str:
    return f"({_hash(key, salt)} / 4294967296.0::DOUBLE)"


def _poisson_cdf(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... as far as 32-bit draws reach, by the recurrence of the probabilities."""
    p, total, out, k = math.exp(-rate), 0.0, [], 0
    while rate > 0 and total + p <= 1.0 - 2.0**-32:
        total += p
        out.append(total)
        k += 1
        p *= rate / k
    return out


def _copies(draw: str, rate: float) -> str:
    return "(" + " + ".join(["0"] + [f"CAST({draw} >= {s!r}::DOUBLE AS INT)" for s in _poisson_cdf(rate)]) + ")"


# --- transactions ------------------------------------------------------------------------------------------------

FACTS = """
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS rec_id,
       l_linestatus, p_type, CAST(floor(l_quantity / 10) AS BIGINT) AS qbin,
       CAST(round(l_discount * 100) AS BIGINT) AS dpct, month(l_shipdate) AS smonth, l_returnflag
FROM lineitem JOIN part ON l_partkey = p_partkey"""

LINES: Ctes = [
    ("facts", FACTS),
    (
        "tx",
        """SELECT 0 AS bag_id, rec_id, 1 AS copy, l_returnflag AS label,
           ['st=' || l_linestatus, 'ty=' || p_type, 'q=' || qbin, 'd=' || dpct, 'm=' || smonth] AS items FROM facts""",
    ),
]
DOCS: Ctes = [
    (
        "tx",
        """SELECT 0 AS bag_id, doc_id AS rec_id, 1 AS copy, CAST(quality AS BIGINT) AS label,
           ['lang=' || lang, 'src=' || source, 'len=' || (length(bin(n_chars + 1)) - 1),
            'nl=' || (length(bin(length(text) - length(replace(text, chr(10), '')) + 1)) - 1),
            'at=' || CAST(contains(text, '@') AS INT), 'http=' || CAST(contains(text, 'http') AS INT)] AS items
           FROM documents JOIN labels USING (doc_id)""",
    )
]
BASKETS: Ctes = [
    (
        "tx",
        """SELECT 0 AS bag_id, o_orderkey AS rec_id, 1 AS copy, any_value(o_orderstatus) AS label,
           list(DISTINCT p_brand ORDER BY p_brand) AS items
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""",
    )
]
WEEKLY: Ctes = [
    (
        "tx",
        """SELECT 0 AS bag_id, user_id || ':' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS rec_id, 1 AS copy,
           CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS label,
           coalesce(list(DISTINCT event_type ORDER BY event_type) FILTER (event_type <> 'purchase'), []) AS items
           FROM events GROUP BY 2""",
    )
]


def _bagged(base: Ctes, models: int, share: float, seed: int, key: str = "rec_id", table: str = "tx") -> Ctes:
    """The sample with replacement, renamed to `tx`; the source stays available as `all_tx`."""
    head = [(n if n != table else "all_tx", s) for n, s in base]
    copies = _copies("u", models * share)
    return [
        *head,
        ("drawn", f"SELECT *, {_draw(key, f'bag{seed}')} AS u FROM all_tx"),
        ("copied", f"SELECT * EXCLUDE (copy, bag_id), unnest(range(1, {copies} + 1)) AS copy FROM drawn"),
        ("tx", f"SELECT *, {_hash(key + chr(32) + '|| chr(47) ||' + chr(32) + 'copy', f'deal{seed}')} % {models} AS bag_id FROM copied"),
    ]


# --- counts and ranks --------------------------------------------------------------------------------------------

COUNTS: Ctes = [
    ("rows_", "SELECT bag_id, row_number() OVER () AS rid, rec_id, label, items FROM tx"),
    ("class_n", "SELECT bag_id, label, count(*) AS n_c FROM rows_ GROUP BY ALL"),
    ("bag_n", "SELECT bag_id, sum(n_c)::BIGINT AS n_all, sum(n_c * n_c) AS sq_all FROM class_n GROUP BY ALL"),
    ("cells", "SELECT bag_id, rid, label, unnest(items) AS item FROM rows_"),
    ("item_c", "SELECT bag_id, item, label, count(*) AS n FROM cells GROUP BY ALL"),
    (
        "stats",
        """SELECT bag_id, item, sum(n)::BIGINT AS n, max(n) AS n_max, sum(n * n) AS sq, any_value(n_all) AS n_all,
           any_value(sq_all) AS sq_all FROM item_c JOIN bag_n USING (bag_id) GROUP BY bag_id, item""",
    ),
]


def _purity(n: str, sq: str) -> str:
    return f"({sq}::DOUBLE / ({n}::DOUBLE * {n}::DOUBLE))"


GAIN = f"((n::DOUBLE / n_all) * ({_purity('n', 'sq')} - {_purity('n_all', 'sq_all')}))"


def _ranks(min_support: float, strategy: str) -> Ctes:
    enough = f"n >= ceil({min_support!r}::DOUBLE * n_all)"
    if strategy == "support":
        where, order = enough, "n DESC, item"
    else:
        where = f"{enough} AND sq::HUGEINT * n_all * n_all > sq_all::HUGEINT * n * n"
        order = f"round({GAIN}, 12) DESC, item DESC"
    return [
        ("ranks", f"""SELECT *, ceil({min_support!r}::DOUBLE * n_all)::BIGINT AS min_count, {GAIN} AS gain,
            row_number() OVER (PARTITION BY bag_id ORDER BY {order}) - 1 AS rank FROM stats WHERE {where}"""),
    ]


# --- measures and order ------------------------------------------------------------------------------------------


def _measured(source: str, exempt: str, min_confidence: float, min_chi2: float, name: str = "rules") -> Ctes:
    """From (bag_id, ant, con, n_ant, n_hit): measures, bounds and rule order."""
    diff = "CAST(n_all::HUGEINT * n_hit - n_ant::HUGEINT * n_c AS DOUBLE)"
    spread = "(n_ant::DOUBLE * n_c::DOUBLE * (n_all::DOUBLE - n_ant) * (n_all::DOUBLE - n_c))"
    chi2 = f"CASE WHEN {spread} = 0 THEN NULL ELSE n_all::DOUBLE * {diff} * {diff} / {spread} END"
    return [
        ("measured", f"""SELECT s.*, n_c, n_all, n_hit::DOUBLE / n_all AS support, n_hit::DOUBLE / n_ant AS confidence,
            {chi2} AS chi2 FROM {source} s JOIN class_n c ON s.bag_id = c.bag_id AND s.con = c.label
            JOIN bag_n b ON s.bag_id = b.bag_id"""),
        ("kept", f"""SELECT * FROM measured WHERE {exempt} OR (confidence >= {min_confidence!r}
            AND (chi2 >= {min_chi2!r} OR chi2 IS NULL))"""),
        (name, f"SELECT *, 1 AS level, {_rank('bag_id')} AS rank FROM kept"),
    ]


TEXT = """printf('%s -> %s (%.6f, %.6f, %s)', array_to_string(ant, ' '), con::VARCHAR, round(support, 6),
    round(confidence, 6), CASE WHEN chi2 IS NULL THEN 'NaN' ELSE printf('%.6f', round(chi2, 6)) END)"""


def _rank(within: str) -> str:
    return f"""row_number() OVER (PARTITION BY {within} ORDER BY confidence DESC, support DESC, len(ant) DESC, {TEXT} DESC)"""


def _show(first: list[str], source: str = "rules", where: str = "true") -> str:
    head = "".join(f"{x}::BIGINT AS {x}, " for x in first)
    return f"""SELECT {head}array_to_string(ant, ' ') AS antecedent, con::VARCHAR AS consequent,
        round(support, 6) AS support, round(confidence, 6) AS confidence, round(chi2, 6) AS chi2
        FROM {source} WHERE {where}"""


# --- mining ------------------------------------------------------------------------------------------------------


def _itemsets(max_length: int) -> Ctes:
    """All subsets of the ranked items, rarest first, counted per class."""
    return [
        ("paths", """SELECT bag_id, label, its, count(*) AS n FROM (SELECT c.bag_id, rid, any_value(c.label) AS label,
            list(c.item ORDER BY rank DESC) AS its FROM cells c JOIN ranks r ON c.bag_id = r.bag_id AND c.item = r.item
            WHERE r.n_max >= r.min_count GROUP BY c.bag_id, rid) GROUP BY ALL"""),
        ("subs", f"""SELECT bag_id, label, its, n, its[1:0] AS ant, 0::BIGINT AS i FROM paths UNION ALL
            SELECT bag_id, label, its, n, list_append(ant, its[j]), j FROM (SELECT *, unnest(range(i + 1, len(its) + 1)) AS j
            FROM subs WHERE len(ant) < {max_length})"""),
        ("set_c", "SELECT bag_id, ant, label AS con, sum(n)::BIGINT AS n_hit FROM subs WHERE len(ant) > 0 GROUP BY ALL"),
        ("limits", "SELECT bag_id, max(min_count) AS min_count FROM ranks GROUP BY ALL"),
        ("sets", """SELECT s.*, min_count, sum(n_hit) OVER w AS n_ant, max(n_hit) OVER w AS n_max FROM set_c s
            JOIN limits USING (bag_id) WINDOW w AS (PARTITION BY bag_id, ant)"""),
    ]


def _support_rules(p: dict, filter_singletons: bool = False) -> Ctes:
    exempt = "false" if filter_singletons else "len(ant) = 1"
    return [
        *COUNTS,
        *_ranks(p["min_support"], "support"),
        *_itemsets(p.get("max_length", 10)),
        ("found", "SELECT bag_id, ant, con, n_ant, n_hit FROM sets WHERE n_max >= min_count AND n_hit = n_max"),
        *_measured("found", exempt, p["min_confidence"], p["min_chi2"]),
    ]


def _tree(paths: str) -> Ctes:
    """Nodes of a prefix tree with their gain over the parent."""
    return [
        ("node_c", f"""SELECT bag_id, its[1:k] AS prefix, label, sum(n)::BIGINT AS n FROM (SELECT *,
            unnest(range(0, len(its) + 1)) AS k FROM {paths}) GROUP BY ALL"""),
        ("nodes", """SELECT bag_id, prefix, sum(n)::BIGINT AS n, max(n) AS n_max, sum(n * n) AS sq,
            arg_min(label, (-n, label)) AS con FROM node_c GROUP BY ALL"""),
        ("judged", f"""SELECT c.*, (c.n::DOUBLE / p.n) * ({_purity('c.n', 'c.sq')} - {_purity('p.n', 'p.sq')}) AS gain,
            c.sq::HUGEINT * p.n * p.n > p.sq::HUGEINT * c.n * c.n AND c.n_max >= min_count AS passes, c.n_max = c.n AS pure
            FROM nodes c JOIN nodes p ON c.bag_id = p.bag_id AND c.prefix[1:len(c.prefix) - 1] = p.prefix
            JOIN limits l ON c.bag_id = l.bag_id WHERE len(c.prefix) > 0"""),
    ]


GAIN_PATHS: Ctes = [
    ("paths", """SELECT bag_id, label, its, count(*) AS n FROM (SELECT c.bag_id, rid, any_value(c.label) AS label,
        list(c.item ORDER BY rank) AS its FROM cells c JOIN ranks r ON c.bag_id = r.bag_id AND c.item = r.item
        GROUP BY c.bag_id, rid) GROUP BY ALL"""),
]


def _gain_rules(p: dict, presorted: bool = False) -> Ctes:
    limit = f"SELECT bag_id, ceil({p['min_support']!r}::DOUBLE * n_all) AS min_count FROM bag_n"
    if presorted:
        paths = [("paths", "SELECT bag_id, label, items AS its, count(*) AS n FROM rows_ GROUP BY ALL")]
    else:
        paths = [*_ranks(p["min_support"], "gain"), *GAIN_PATHS]
    return [
        *COUNTS,
        *paths,
        ("limits", limit),
        *_tree("paths"),
        ("qualified", """SELECT * FROM judged WHERE len(prefix) = 1 AND passes UNION ALL
            SELECT j.* FROM judged j JOIN qualified q ON j.bag_id = q.bag_id AND j.prefix[1:len(j.prefix) - 1] = q.prefix
            WHERE j.passes AND NOT q.pure"""),
        ("found", """SELECT q.bag_id, q.prefix AS ant, q.con, sum(t.n)::BIGINT AS n_ant,
            sum(CASE WHEN t.label = q.con THEN t.n ELSE 0 END)::BIGINT AS n_hit FROM qualified q JOIN paths t
            ON t.bag_id = q.bag_id AND list_has_all(t.its, q.prefix) GROUP BY q.bag_id, q.prefix, q.con"""),
        *_measured("found", "false", p["min_confidence"], p["min_chi2"], "survivors"),
        ("deepest", """SELECT * EXCLUDE (rank) FROM survivors s WHERE NOT EXISTS (SELECT 1 FROM survivors d
            WHERE d.bag_id = s.bag_id AND len(d.ant) > len(s.ant) AND d.ant[1:len(s.ant)] = s.ant)"""),
        ("rules", f"SELECT *, {_rank('bag_id')} AS rank FROM deepest"),
    ]


def _token_rules(p: dict) -> Ctes:
    return [
        *COUNTS,
        *_ranks(p["min_support"], "support"),
        *_itemsets(100),
        ("found", "SELECT bag_id, ant, con, n_ant, n_hit FROM sets WHERE n_hit >= min_count"),
        *_measured("found", "false", p["min_confidence"], p["min_chi2"]),
    ]


# --- coverage ----------------------------------------------------------------------------------------------------


def _coverage(data: str, source: str = "rules", on: str = "true", name: str = "covered") -> Ctes:
    """Rule by rule in rank order, the state being the ranks of the used rules so far.

    `data` has rid, items, label. A record is claimed if a used rule of smaller rank applies to it, so a rule sees
    each record as the list of smaller ranks that apply, and whether the rule is right about it.
    """
    return [
        ("pairs", f"""SELECT r.bag_id, r.rank, d.rid, d.label = r.con AS good, d.label FROM {source} r JOIN {data} d
            ON {on} AND list_has_all(d.items, r.ant)"""),
        ("seen", "SELECT bag_id, rid, list(rank ORDER BY rank) AS all_ranks FROM pairs GROUP BY ALL"),
        ("looks", """SELECT DISTINCT p.bag_id, rank, good, list_filter(all_ranks, lambda x: x < p.rank) AS smaller
            FROM pairs p JOIN seen s ON p.bag_id = s.bag_id AND p.rid = s.rid"""),
        ("hits", f"""SELECT r.bag_id, r.rank, coalesce(list(smaller) FILTER (good), []) AS good_,
            coalesce(list(smaller) FILTER (smaller IS NOT NULL), []) AS any_
            FROM {source} r LEFT JOIN looks l ON r.bag_id = l.bag_id AND r.rank = l.rank GROUP BY r.bag_id, r.rank"""),
        ("walk", """SELECT bag_id, 0::BIGINT AS rank, CAST([] AS BIGINT[]) AS used, 0 AS state FROM
            (SELECT DISTINCT bag_id FROM hits) UNION ALL
            SELECT bag_id, rank, CASE WHEN state = 1 THEN list_append(used, rank) ELSE used END, state FROM (
                SELECT w.bag_id, h.rank, w.used, CASE
                    WHEN len(list_filter(h.good_, lambda x: NOT list_has_any(x, w.used))) > 0 THEN 1
                    WHEN len(list_filter(h.any_, lambda x: NOT list_has_any(x, w.used))) > 0 THEN 0
                    ELSE 2 END AS state
                FROM walk w JOIN hits h ON h.bag_id = w.bag_id AND h.rank = w.rank + 1)"""),
        (name, f"""SELECT r.* EXCLUDE (level), w.state AS level FROM {source} r JOIN walk w
            ON r.bag_id = w.bag_id AND r.rank = w.rank WHERE w.state > 0"""),
    ]


JUDGED: Ctes = [("judged_docs", "SELECT row_number() OVER () AS rid, items, label FROM tx")]


def _merged(method: str, source: str, within: str = "") -> Ctes:
    agg = {"max": "max({0})", "min": "min({0})", "product": "1.0 - product(1.0 - {0})"}[method]
    return [
        ("as_sets", f"SELECT *, list_sort(ant) AS aset FROM {source}"),
        ("combined", f"""SELECT {within} level, aset, con, arg_min(ant, (bag_id, rank)) AS ant,
            {agg.format('support')} AS support, {agg.format('confidence')} AS confidence,
            CASE WHEN bool_or(chi2 IS NULL) THEN NULL ELSE max(chi2) END AS chi2 FROM as_sets
            GROUP BY {within} level, aset, con"""),
        ("merged", f"SELECT *, {_rank(within + ' level')} AS rank FROM combined"),
    ]


# --- scoring -----------------------------------------------------------------------------------------------------


def _proba(
    voting: str, metric: str, weight: str, classes: list, default: str | None = None, keys: str = "rec_id",
    source: str = "rules", data: str = "tx", on: str = "true", all_keys: str | None = None,
) -> Ctes:
    """(keys, probs list) over level-1 rules; `default` is a list expression, uniform if not given."""
    vote = "1 - r.support" if metric == "support" else "r.confidence"
    combine = {"mean": "avg", "min": "min", "max": "max"}[voting]
    k = len(classes)
    lits = [f"'{x}'" if isinstance(x, str) else str(x) for x in classes]
    cols = ", ".join(
        f"{combine}(CASE WHEN r.con = {x} THEN {vote} END) AS v{i}, count(CASE WHEN r.con = {x} THEN 1 END) AS n{i}"
        for i, x in enumerate(lits)
    )
    rest = " * ".join(f"(1 - coalesce(v{i}, 0))" for i in range(k))
    if (voting, metric, weight) == ("max", "confidence", "none"):
        missing = " + ".join(f"CAST(v{i} IS NULL AS INT)" for i in range(k))
        rest = f"({rest}) / greatest(1, {missing})"
    total_n = " + ".join(f"n{i}" for i in range(k))
    share = "n{0}::DOUBLE / rules_n * v{0}" if weight == "numRules" else "v{0}"
    sums = " + ".join(f"s{i}" for i in range(k))
    default = default or "[" + ", ".join([f"1.0::DOUBLE / {k}"] * k) + "]"
    return [
        ("votes", f"""SELECT {", ".join("t." + x.strip() for x in keys.split(","))}, {cols} FROM {data} t LEFT JOIN (SELECT * FROM {source}
            WHERE level = 1) r ON {on} AND list_has_all(t.items, r.ant) GROUP BY ALL"""),
        ("rests", f"SELECT *, {rest} AS rest, {total_n} AS rules_n FROM votes"),
        ("shares", f"SELECT *, {', '.join(f'coalesce({share.format(i)}, rest) AS s{i}' for i in range(k))} FROM rests"),
        ("probs", f"""SELECT *, CASE WHEN rules_n = 0 THEN {default} ELSE
            [{', '.join(f's{i} / ({sums})' for i in range(k))}] END AS p FROM shares"""),
    ]


def _show_p(classes: list, source: str = "probs") -> str:
    return "SELECT rec_id, " + ", ".join(f"round(p[{i + 1}], 6) AS p_{x}" for i, x in enumerate(classes)) + f" FROM {source}"


FIRST_HITS: Ctes = [
    ("matched", """SELECT t.rec_id, r.bag_id, arg_min(r.con, (r.level, r.rank)) AS con FROM tx_all t JOIN rules r
        ON list_has_all(t.items, r.ant) GROUP BY t.rec_id, r.bag_id"""),
]


def _majority(votes: str, default: str) -> Ctes:
    """Most frequent `con` per record in `votes`, smallest on ties; `default` where there is none."""
    return [
        ("tally", f"SELECT rec_id, con, count(*) AS n FROM ({votes}) GROUP BY ALL"),
        ("winner", "SELECT rec_id, arg_min(con, (-n, con)) AS con FROM tally GROUP BY ALL"),
        ("predicted", f"SELECT t.rec_id, coalesce(w.con, {default}) AS prediction FROM tx_all t LEFT JOIN winner w USING (rec_id)"),
    ]


def _doc_ensemble() -> Ctes:
    return [*_bagged(DOCS, c.BAGS, c.BAG_SHARE, c.SEED), *_support_rules(c.DOCS), ("tx_all", "SELECT * FROM all_tx")]


BAG_DEFAULTS: Ctes = [
    ("bag_default", "SELECT bag_id, arg_min(label, (-n_c, label)) AS dc FROM class_n GROUP BY ALL"),
    ("overall_default", "SELECT arg_min(dc, (-n, dc)) AS dc FROM (SELECT dc, count(*) AS n FROM bag_default GROUP BY ALL)"),
]


# --- cross-validation --------------------------------------------------------------------------------------------


def _fold_rules() -> Ctes:
    """Gain rules of 2 bags for each of the training folds; bag ids are fold * 2 + bag."""
    fold = f"{_hash('rec_id', f'fold{c.FOLD_SEED}')} % {c.FOLDS}"
    base = [(n, s) if n != "tx" else ("plain_tx", s) for n, s in DOCS]
    base.append(("tx", f"SELECT *, {fold} AS own_fold FROM plain_tx"))
    bagged = _bagged(base, 2, 0.5, c.SEED)
    name, last = bagged[-1]
    return [
        *bagged[:-1],
        ("dealt", last),
        ("tx", f"""SELECT d.* REPLACE (f.f * 2 + d.bag_id AS bag_id) FROM dealt d JOIN (SELECT unnest(range(0, {c.FOLDS})) AS f) f
            ON f.f <> d.own_fold"""),
        *_gain_rules(c.DOCS_GAIN),
        ("fold_rules", "SELECT * REPLACE (bag_id % 2 AS bag_id), bag_id // 2 AS fold FROM rules"),
    ]


def _fold_predictions() -> Ctes:
    return [
        *_fold_rules(),
        ("fold_default", """SELECT fold, arg_min(dc, (-n, dc)) AS dc FROM (SELECT bag_id // 2 AS fold, dc, count(*) AS n FROM
            (SELECT bag_id, arg_min(label, (-n_c, label)) AS dc FROM class_n GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""),
        ("bag_votes", """SELECT t.rec_id, r.bag_id, arg_min(r.con, (r.level, r.rank)) AS con FROM all_tx t JOIN fold_rules r
            ON t.own_fold = r.fold AND list_has_all(t.items, r.ant) GROUP BY t.rec_id, r.bag_id"""),
        ("tally", "SELECT rec_id, con, count(*) AS n FROM bag_votes GROUP BY ALL"),
        ("winner", "SELECT rec_id, arg_min(con, (-n, con)) AS con FROM tally GROUP BY ALL"),
        ("predicted", """SELECT t.rec_id, t.label, t.own_fold AS fold, coalesce(w.con, d.dc) AS prediction FROM all_tx t
            LEFT JOIN winner w USING (rec_id) LEFT JOIN fold_default d ON d.fold = t.own_fold"""),
    ]


def _scores(voting: str) -> Ctes:
    """Scores of the held-out records by each fold's merged model, and their curves."""
    return [
        *_merged("max", "fold_rules", "fold,"),
        ("prior", "SELECT [1 - avg(label), avg(label)] AS p FROM all_tx"),
        *_proba(
            voting, "confidence", "none", [0, 1], "(SELECT p FROM prior)", "rec_id, label, own_fold",
            "merged", "all_tx", "t.own_fold = r.fold",
        ),
        ("scored", "SELECT rec_id, label, own_fold AS fold, p[2] AS score FROM probs"),
        ("points", """SELECT fold, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored
            GROUP BY ALL"""),
        ("curve", """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER f AS np, sum(neg) OVER f AS nn
            FROM points WINDOW w AS (PARTITION BY fold ORDER BY score DESC), f AS (PARTITION BY fold)"""),
        ("areas", """SELECT fold, CASE WHEN any_value(np) = 0 THEN 0.0 WHEN any_value(nn) = 0 THEN 1.0 ELSE
            sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(np) * any_value(nn)::DOUBLE) END AS auc
            FROM curve GROUP BY fold"""),
        ("steps", "SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS threshold"),
        ("accuracies", """SELECT fold, threshold, avg(CAST((score >= threshold) = (label = 1) AS INT)) AS accuracy
            FROM scored, steps GROUP BY ALL"""),
        ("best_step", """SELECT threshold, avg(accuracy) AS mean, stddev_pop(accuracy) AS stddev FROM accuracies
            GROUP BY threshold ORDER BY round(avg(accuracy), 12) DESC, threshold LIMIT 1"""),
    ]


def _fold_scores() -> Ctes:
    return [*_fold_rules(), *_scores("max")]


def _grid_point(mode: str, voting: str) -> str:
    """One point of the grid: classes resampled to equal size, gain rules of 2 bags per fold, merged, scored."""
    goal = {"over": "max(n)", "under": "min(n)"}[mode]
    fold = f"{_hash('rec_id', f'fold{c.FOLD_SEED}')} % {c.FOLDS}"
    base = [(n, s) if n != "tx" else ("plain_tx", s) for n, s in DOCS]
    ctes: Ctes = [
        *base,
        ("all_tx", f"SELECT *, {fold} AS own_fold, {_draw('rec_id', f'strata{c.SEED}')} AS u FROM plain_tx"),
        ("sizes", "SELECT label, count(*) AS n FROM all_tx GROUP BY ALL"),
        ("rates", f"SELECT label, (SELECT {goal} FROM sizes)::DOUBLE / n AS rate FROM sizes"),
        ("pmf", """SELECT label, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates,
            (SELECT unnest(range(0, 60)) AS k)"""),
        ("cdf", "SELECT label, k, sum(p) OVER (PARTITION BY label ORDER BY k) AS t FROM pmf"),
        ("times", """SELECT t.rec_id, count(*) AS copies FROM all_tx t JOIN cdf c ON c.label = t.label AND c.t <= t.u
            GROUP BY ALL"""),
        ("resampled", """SELECT rec_id || '/' || unnest(range(1, copies + 1)) AS rec_id, label, items, own_fold
            FROM all_tx JOIN times USING (rec_id)"""),
        ("tx", f"""SELECT f.f * 2 + {_hash("r.rec_id || '/1'", f'deal{c.SEED}')} % 2 AS bag_id, r.rec_id, 1 AS copy, label, items
            FROM resampled r JOIN (SELECT unnest(range(0, {c.FOLDS})) AS f) f ON f.f <> r.own_fold
            WHERE {_draw('r.rec_id', f'bag{c.SEED}')} < {2 * 0.5!r}"""),
        *_gain_rules(c.DOCS_GAIN),
        ("fold_rules", "SELECT * REPLACE (bag_id % 2 AS bag_id), bag_id // 2 AS fold FROM rules"),
        *_scores(voting),
    ]
    head = f"'{mode}sampling' AS sampling, '{voting}' AS voting, 'none' AS weight"
    numbers = "round({0}, 6) AS mean, round({1}, 6) AS stddev"
    final = f"""SELECT {head}, 'auc' AS measure, {numbers.format('avg(auc)', 'stddev_pop(auc)')} FROM areas
        UNION ALL SELECT {head}, 'accuracy', {numbers.format('avg(accuracy)', 'stddev_pop(accuracy)')} FROM accuracies
        WHERE threshold = 0.6::DOUBLE
        UNION ALL SELECT {head}, 'accuracy at ' || printf('%.1f', threshold), {numbers.format('mean', 'stddev')} FROM best_step"""
    ctes.append(("model_sizes", """SELECT f.fold, coalesce(c.n, 0) AS rules, coalesce(m.n1, 0) AS light_rules_1,
        coalesce(m.n2, 0) AS light_rules_2, coalesce(m.l1, 0) AS length_1, coalesce(m.l2, 0) AS length_2
        FROM (SELECT DISTINCT own_fold AS fold FROM all_tx) f
        LEFT JOIN (SELECT fold, count(*) AS n FROM fold_rules GROUP BY ALL) c ON c.fold = f.fold
        LEFT JOIN (SELECT fold, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2,
            avg(len(ant)) FILTER (level = 1) AS l1, avg(len(ant)) FILTER (level = 2) AS l2 FROM merged GROUP BY ALL) m
            ON m.fold = f.fold"""))
    for measure in ("rules", "light_rules_1", "light_rules_2", "length_1", "length_2"):
        final += f" UNION ALL SELECT {head}, '{measure}', {numbers.format(f'avg({measure})', f'stddev_pop({measure})')} FROM model_sizes"
    return f"SELECT * FROM ({_statement(ctes, final)})"


# --- statements --------------------------------------------------------------------------------------------------


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    split = r"regexp_split_to_array(regexp_replace(value, ',+$', ''), ',')"
    ragged = """SELECT rec_id, concat_ws(',', l_linestatus, CASE WHEN dpct > 5 THEN '' ELSE p_type END,
        CASE WHEN qbin > 2 THEN '' ELSE qbin::VARCHAR END, CASE WHEN smonth > 6 THEN '' ELSE smonth::VARCHAR END) AS value
        FROM facts"""
    sql["text_prep"] = _statement(
        [("facts", FACTS), ("raw", ragged)],
        f"SELECT rec_id, len({split}) AS n_fields, array_to_string({split}, '|') AS fields FROM raw",
    )
    entries: Ctes = [
        ("facts", FACTS),
        ("recs", """SELECT rec_id, [l_linestatus, p_type, qbin::VARCHAR, dpct::VARCHAR, smonth::VARCHAR, l_returnflag] AS f
            FROM facts"""),
        ("fcells", "SELECT rec_id, unnest(f) AS value, unnest(range(0, 6)) AS pos FROM recs"),
        ("dict", """SELECT pos, value, row_number() OVER (ORDER BY pos DESC, value) - 1 AS item_id
            FROM (SELECT DISTINCT pos, value FROM fcells)"""),
    ]
    sql["dictionary"] = _statement(entries, "SELECT pos, value, item_id FROM dict")
    sql["encode"] = _statement(
        [
            *entries,
            ("classes", "SELECT count(*) AS k FROM dict WHERE pos = 5"),
            ("enc", "SELECT rec_id, pos, item_id FROM fcells JOIN dict USING (pos, value)"),
        ],
        """SELECT rec_id, string_agg(item_id::VARCHAR, ' ' ORDER BY pos) FILTER (item_id >= k) AS items,
           min(item_id) AS label, any_value(k) AS num_classes FROM enc, classes GROUP BY rec_id""",
    )

    sql["encode_least_id"] = _statement(
        [*entries, ("enc", "SELECT rec_id, pos, item_id, min(item_id) OVER (PARTITION BY rec_id) AS least FROM fcells JOIN dict USING (pos, value)")],
        """SELECT rec_id, string_agg(item_id::VARCHAR, ' ' ORDER BY pos) FILTER (item_id <> least) AS items, any_value(least) AS label
           FROM enc GROUP BY rec_id""",
    )

    line_bags = _bagged(LINES, c.BAGS, c.BAG_SHARE, c.SEED)
    sql["class_prior"] = _statement(
        [*line_bags, *COUNTS, *BAG_DEFAULTS],
        """SELECT c.bag_id, label, n_c AS n_class, n_all AS n_total, round(n_c::DOUBLE / n_all, 6) AS prior, dc AS default_class
           FROM class_n c JOIN bag_n b ON c.bag_id = b.bag_id JOIN bag_default d ON c.bag_id = d.bag_id""",
    )
    covered = [*DOCS, *JUDGED, *_support_rules(c.DOCS), *_coverage("judged_docs")]
    sql["rules_text"] = _statement(covered, f"SELECT level::BIGINT AS level, rank::BIGINT AS rank, {TEXT} AS line FROM covered")

    sql["bag_sample"] = _statement(line_bags, "SELECT rec_id, copy, bag_id FROM tx")
    sql["bag_without_replacement"] = _statement(
        LINES,
        f"""SELECT rec_id, {_hash("rec_id || '/1'", f'deal{c.SEED}')} % 4 AS bag_id FROM tx
            WHERE {_draw('rec_id', f'bag{c.SEED}')} < {4 * 0.2!r}""",
    )
    sql["bag_even"] = _statement(
        LINES,
        f"""SELECT rec_id, (row_number() OVER (ORDER BY {_hash("rec_id || '/1'", f'deal{c.SEED}')}, rec_id) - 1) % 4 AS bag_id
            FROM tx WHERE {_draw('rec_id', f'bag{c.SEED}')} < {4 * 0.2!r}""",
    )
    sql["bag_contiguous"] = _statement(
        [*BASKETS, ("kept_tx", f"SELECT rec_id FROM tx WHERE {_draw('rec_id', f'bag{c.SEED}')} < {8 * 0.1!r}")],
        """SELECT rec_id, ((row_number() OVER (ORDER BY rec_id) - 1) * 8) // (SELECT count(*) FROM kept_tx) AS bag_id FROM kept_tx""",
    )
    key = "concat_ws(':', l_orderkey, l_linenumber, l_partkey)"
    sql["bag_by_partition"] = f"""SELECT count(*)::BIGINT AS sampled, 0::BIGINT AS split_partitions FROM lineitem
        WHERE {_draw(key, f'bag{c.SEED}')} < {2 * 0.3!r}"""
    rates = " ".join(f"WHEN label = {k} THEN {_copies('u', v)}" for k, v in c.FRACTIONS.items())
    sql["stratified_resample"] = _statement(
        [*DOCS, ("drawn", f"SELECT *, {_draw('rec_id', f'strata{c.SEED}')} AS u FROM tx")],
        f"SELECT rec_id, label, unnest(range(1, CASE {rates} END + 1)) AS copy FROM drawn",
    )
    sql["kfold"] = _statement(
        LINES,
        f"""SELECT rec_id, {_hash('rec_id', f'fold{c.FOLD_SEED}')} % 10 AS fold,
            CASE WHEN {_draw('rec_id', f'split{c.SEED}')} < 0.7::DOUBLE THEN 'train' ELSE 'test' END AS part FROM tx""",
    )

    sql["item_support"] = _statement(
        [*line_bags, *COUNTS, *_ranks(c.LINES["min_support"], "support")],
        "SELECT bag_id, rank, n, n_max, min_count, item FROM ranks",
    )
    line_gain = _ranks(c.LINES["min_support"], "gain")
    sql["item_gain"] = _statement(
        [*line_bags, *COUNTS, *line_gain],
        f"SELECT bag_id, rank, n, item, round(1.0 - {_purity('n', 'sq')}, 6) AS gini, round(gain, 9) AS gain FROM ranks",
    )
    sql["feature_select"] = _statement(
        [
            *LINES,
            *COUNTS,
            ("spots", "SELECT label, unnest(items) AS item, unnest(range(0, len(items))) AS pos FROM rows_"),
            ("spot_c", "SELECT pos, label, count(*) AS n FROM spots GROUP BY ALL"),
            ("spot_s", """SELECT pos, sum(n)::BIGINT AS n, sum(n * n) AS sq, any_value(n_all) AS n_all, any_value(sq_all) AS sq_all
                FROM spot_c, bag_n GROUP BY pos"""),
            ("best", f"SELECT list(pos) AS kept FROM (SELECT pos FROM spot_s ORDER BY round({GAIN}, 12) DESC, pos LIMIT 3)"),
        ],
        """SELECT rec_id, array_to_string(list_filter(items, lambda x, i: list_contains(kept, i - 1)), ' ') AS items
           FROM rows_, best""",
    )
    line_paths = [*LINES, *COUNTS, *line_gain]
    sql["rank_tx"] = _statement(
        line_paths,
        """SELECT rec_id, string_agg(rank::VARCHAR, ' ' ORDER BY rank) AS ranks FROM cells c JOIN ranks r
           ON c.bag_id = r.bag_id AND c.item = r.item JOIN rows_ USING (rid) GROUP BY rec_id""",
    )
    rank_paths = [
        *line_paths,
        ("paths", """SELECT bag_id, label, its, count(*) AS n FROM (SELECT c.bag_id, rid, any_value(c.label) AS label,
            list(rank ORDER BY rank) AS its FROM cells c JOIN ranks r ON c.bag_id = r.bag_id AND c.item = r.item
            GROUP BY c.bag_id, rid) GROUP BY ALL"""),
    ]
    sql["prefix_nodes"] = _statement(
        rank_paths,
        """SELECT array_to_string(its[1:k], ' ') AS prefix, label, sum(n)::BIGINT AS n FROM (SELECT *,
           unnest(range(1, len(its) + 1)) AS k FROM paths) GROUP BY ALL""",
    )
    sql["prefix_merge"] = _statement(
        BASKETS,
        """SELECT array_to_string(items[1:k], ' ') AS prefix, label, count(*) AS n FROM (SELECT *,
           unnest(range(1, len(items) + 1)) AS k FROM tx) GROUP BY ALL""",
    )
    sql["tree_transactions"] = _statement(rank_paths, "SELECT array_to_string(its, ' ') AS ranks, label, n FROM paths")
    sql["conditional_base"] = _statement(
        BASKETS,
        f"""SELECT array_to_string(items[1:list_position(items, '{c.SUFFIX}') - 1], ' ') AS ranks, label, count(*) AS n FROM tx
           WHERE list_contains(items, '{c.SUFFIX}') GROUP BY ALL""",
    )
    sql["header_summary"] = _statement(
        rank_paths,
        "SELECT item, label, sum(n)::BIGINT AS n FROM (SELECT unnest(its) AS item, label, n FROM paths) GROUP BY ALL",
    )

    line_rules = [*LINES, *_support_rules(c.LINES)]
    sql["rules_support"] = _statement(line_rules, _show(["rank"]))
    sql["rules_support_filtered"] = _statement(
        [*LINES, *_support_rules({**c.LINES, "min_chi2": 3.841}, True)], _show(["rank"])
    )
    sql["rules_support_baskets"] = _statement([*BASKETS, *_support_rules(c.BASKETS)], _show(["rank"]))
    weekly = {"min_support": 0.01, "min_confidence": 0.5, "min_chi2": 0.0}
    sql["rules_support_weekly"] = _statement([*WEEKLY, *_support_rules(weekly)], _show(["rank"]))
    sql["rules_gain"] = _statement([*DOCS, *_gain_rules(c.DOCS_GAIN)], _show(["rank"]))
    fine = {"min_support": 0.005, "min_confidence": 0.34, "min_chi2": 0.0}
    sql["rules_gain_bags"] = _statement([*line_bags, *_gain_rules(fine)], _show(["bag_id", "rank"]))
    sql["rules_gain_presorted"] = _statement([*LINES, *_gain_rules(fine, True)], _show(["rank"]))
    sql["node_gain"] = _statement(
        [*rank_paths, ("limits", "SELECT bag_id, ceil(0.001::DOUBLE * n_all) AS min_count FROM bag_n"), *_tree("paths")],
        """SELECT array_to_string(prefix, ' ') AS prefix, n, n_max, round(gain, 9) AS gain, passes::BIGINT AS passes,
           pure::BIGINT AS pure FROM judged""",
    )
    sql["rule_metrics"] = _statement(
        [
            *BASKETS,
            *COUNTS,
            ("found", """SELECT bag_id, [item] AS ant, label AS con, n AS n_hit,
                sum(n) OVER (PARTITION BY bag_id, item)::BIGINT AS n_ant FROM item_c"""),
            *_measured("found", "true", 0.0, 0.0),
        ],
        """SELECT ant[1] AS item, con AS consequent, n_ant, n_hit, n_c AS n_class, n_all AS n_total,
           round(support, 6) AS support, round(confidence, 6) AS confidence, round(chi2, 6) AS chi2 FROM rules""",
    )
    sql["rules_ordered"] = _statement(
        line_rules,
        f"""SELECT len(ant) AS length, {_rank('len(ant)')} AS rank, array_to_string(ant, ' ') AS antecedent, con AS consequent
            FROM rules""",
    )
    sql["rules_classtoken"] = _statement([*BASKETS, *_token_rules(c.BASKETS)], _show(["rank"]))
    sql["ensemble_rules"] = _statement(_doc_ensemble(), _show(["bag_id", "rank"]))

    sql["coverage_used"] = _statement(covered, _show(["rank"], "covered", "level = 1"))
    sql["coverage_spare"] = _statement(covered, _show(["rank"], "covered", "level = 2"))
    flat = ("flat", "SELECT * REPLACE (row_number() OVER (ORDER BY level, rank) AS rank) FROM covered")
    sql["coverage_flat"] = _statement([*covered, flat], _show(["rank"], "flat"))
    judged_docs_all = [(n, s.replace("FROM tx", "FROM all_tx")) for n, s in JUDGED]
    covered_ensemble = [*_doc_ensemble(), *judged_docs_all, *_coverage("judged_docs")]
    sql["coverage_ensemble"] = _statement(covered_ensemble, _show(["bag_id", "level", "rank"], "covered"))
    sql["coverage_lines"] = _statement(
        [*line_rules, *_coverage("rows_")], _show(["level", "rank"], "covered")
    )
    bagged_lines = [
        *_bagged(LINES, 4, 0.25, c.SEED), *_support_rules(c.LINES), *_coverage("rows_", on="d.bag_id = r.bag_id"),
        *_merged("max", "covered"),
    ]
    sql["ensemble_training"] = _statement(bagged_lines, _show(["level", "rank"], "merged"))
    for method in ("max", "min", "product"):
        sql[f"merge_{method}"] = _statement(
            [*covered_ensemble, *_merged(method, "covered")], _show(["level", "rank"], "merged")
        )

    sql["rule_match"] = _statement(
        [*DOCS, *_support_rules(c.DOCS)],
        "SELECT t.rec_id, r.rank FROM tx t JOIN rules r ON list_has_all(t.items, r.ant)",
    )
    first = [
        *line_rules,
        ("best", """SELECT t.rec_id, t.label, coalesce(arg_min(r.con, r.rank), 'N') AS prediction FROM tx t LEFT JOIN rules r
            ON list_has_all(t.items, r.ant) GROUP BY ALL"""),
    ]
    sql["first_match"] = _statement(first, "SELECT rec_id, prediction FROM best")
    sql["first_match_levels"] = _statement(
        covered,
        """SELECT t.rec_id, coalesce(arg_min(r.con, (r.level, r.rank)), 1) AS prediction FROM tx t LEFT JOIN covered r
           ON list_has_all(t.items, r.ant) GROUP BY t.rec_id""",
    )
    for name, v in c.VOTES.items():
        sql[name] = _statement(
            [*line_rules, *_proba(v.voting, v.metric, v.weight, c.LINE_CLASSES)], _show_p(c.LINE_CLASSES)
        )
    sql["vote_predict"] = _statement(
        [*line_rules, *_proba("max", "confidence", "none", c.LINE_CLASSES)],
        "SELECT rec_id, ['A', 'N', 'R'][list_position(p, list_max(p))] AS prediction FROM probs",
    )
    ensemble = [*_doc_ensemble(), *BAG_DEFAULTS, *FIRST_HITS]
    sql["ensemble_predict"] = _statement(
        [*ensemble, *_majority("SELECT rec_id, con FROM matched", "(SELECT dc FROM overall_default)")],
        "SELECT rec_id, prediction FROM predicted",
    )
    sql["saved_model_predict"] = sql["ensemble_predict"]
    everyone = """SELECT t.rec_id, coalesce(m.con, d.dc) AS con FROM tx_all t, bag_default d LEFT JOIN matched m
        ON m.rec_id = t.rec_id AND m.bag_id = d.bag_id"""
    sql["ensemble_majority"] = _statement(
        [*ensemble, *_majority(everyone, "NULL")], "SELECT rec_id, prediction FROM predicted"
    )
    per_bag = [
        *_doc_ensemble(),
        ("rec_bags", "SELECT t.rec_id, t.items, b.bag_id AS bag FROM tx_all t, bag_n b"),
        *_proba("max", "confidence", "none", [0, 1], None, "rec_id, bag", "rules", "rec_bags", "t.bag = r.bag_id"),
    ]
    sql["ensemble_proba"] = _statement(
        [*per_bag, ("total", "SELECT rec_id, sum(p[1]) AS a, sum(p[2]) AS b FROM probs GROUP BY ALL")],
        "SELECT rec_id, round(a / (a + b), 6) AS p_0, round(b / (a + b), 6) AS p_1 FROM total",
    )
    sql["ensemble_weighted"] = _statement(
        [
            *per_bag,
            *_majority("SELECT rec_id, list_position(p, list_max(p)) - 1 AS con FROM probs", "NULL"),
        ],
        "SELECT rec_id, prediction::BIGINT AS prediction FROM predicted",
    )

    sql["model_stats"] = _statement(
        [
            *covered_ensemble,
            ("per_bag", """SELECT b.bag_id, count(*) FILTER (level = 1) AS r1, count(*) FILTER (level = 2) AS r2,
                coalesce(sum(len(ant)) FILTER (level = 1), 0) AS i1, coalesce(sum(len(ant)) FILTER (level = 2), 0) AS i2,
                coalesce(avg(len(ant)) FILTER (level = 1), 0) AS l1, coalesce(avg(len(ant)) FILTER (level = 2), 0) AS l2
                FROM bag_n b LEFT JOIN covered c ON b.bag_id = c.bag_id GROUP BY b.bag_id"""),
        ],
        """SELECT sum(r1)::BIGINT AS rules_1, sum(r2)::BIGINT AS rules_2, sum(i1)::BIGINT AS items_1, sum(i2)::BIGINT AS items_2,
           round(avg(l1), 6) AS length_1, round(avg(l2), 6) AS length_2 FROM per_bag""",
    )
    sql["confusion"] = _statement(first, "SELECT label, prediction, count(*) AS n FROM best GROUP BY ALL")
    sql["accuracy"] = _statement(
        first,
        """SELECT count(*) AS n, round(avg(CAST(label = prediction AS INT)), 6) AS accuracy,
           round(avg(CAST(label <> prediction AS INT)), 6) AS test_error FROM best""",
    )
    sql["cv_confusion"] = _statement(
        _fold_predictions(),
        """SELECT label, prediction, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM predicted), 6) AS share
           FROM predicted GROUP BY label, prediction""",
    )
    sql["cv_summary"] = _statement(
        [
            *_fold_predictions(),
            ("acc", "SELECT fold, avg(CAST(label = prediction AS INT)) AS accuracy FROM predicted GROUP BY ALL"),
            ("sizes", """SELECT fold, count(*) FILTER (level = 1) AS r1, count(*) FILTER (level = 2) AS r2, sum(len(ant)) AS items
                FROM fold_rules GROUP BY ALL"""),
            ("long", """SELECT unnest(['accuracy', 'rules_1', 'rules_2', 'items']) AS measure, unnest([accuracy,
                coalesce(r1, 0)::DOUBLE, coalesce(r2, 0)::DOUBLE, coalesce(items, 0)::DOUBLE]) AS v FROM acc LEFT JOIN sizes USING (fold)"""),
        ],
        """SELECT measure, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS stddev
           FROM long GROUP BY measure""",
    )
    scores = _fold_scores()
    sql["roc"] = _statement(
        scores,
        """SELECT fold, 1::BIGINT AS part, round(score, 6) AS score, 
           CASE WHEN nn = 0 THEN 0 ELSE round(fp::DOUBLE / nn, 6) END AS fpr, CASE WHEN np = 0 THEN 0 ELSE round(tp::DOUBLE / np, 6) END AS tpr
           FROM curve UNION ALL SELECT DISTINCT fold, e.part, NULL::DOUBLE, e.v, e.v FROM points,
           (SELECT unnest([0, 2])::BIGINT AS part, unnest([0.0, 1.0])::DOUBLE AS v) e""",
    )
    sql["auc"] = _statement(scores, "SELECT fold, round(auc, 6) AS auc FROM areas")
    sql["accuracy_curve"] = _statement(
        scores, "SELECT fold, round(threshold, 1) AS threshold, round(accuracy, 6) AS accuracy FROM accuracies"
    )
    sql["best_threshold"] = _statement(
        scores,
        "SELECT round(threshold, 1) AS threshold, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM best_step",
    )
    sql["grid"] = " UNION ALL ".join(_grid_point(m, v) for m in ("over", "under") for v in ("max", "min"))
    return sql
