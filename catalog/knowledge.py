"""Trial evidence, recorded sequences, similar data sets and views of the search log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import table, view, with_views
from catalog.profiles import BY_MOMENTS, ENTROPY, METHODS, MISSING, MOMENTS, corr_sql
from catalog.registry import query, r, rnd, rounded
from winnow.operators import profile
from winnow.plans import knowledge as K
from winnow.plans import ledger as L
from winnow.plans import trials as TR
from winnow.sources import tables

# ---------------------------------------------------------------- recorded sequences

# arrays of the recorded view; 'none' becomes NULL inside the JSON text
SEQ = """sq AS (SELECT dataset, pos, score, string_split(logic_pipe, '_') AS steps,
  list_prepend(imputer, list_transform(string_split(phy_pipe, '_'), lambda x: nullif(x, 'none'))) AS ops FROM recorded)"""
TXT_ORDER = "array_to_string(steps, ',')"
TXT_OPS = "array_to_string(list_transform(ops, lambda x: coalesce(x, 'none')), ',')"


def text(df):
    """Arrays as comma-joined text, NULL operators spelled 'none'."""
    return df.withColumn("step_order", F.concat_ws(",", "step_order")).withColumn(
        "ops", F.concat_ws(",", F.transform("ops", lambda o: F.coalesce(o, F.lit("none"))))
    )


def recorded_json(spark, sf):
    """One JSON text per data set, as the history files hold it."""
    rec = view(spark, sf, "recorded")
    ops = F.concat(
        F.array("imputer"),
        F.transform(F.split("phy_pipe", "_"), lambda o: F.when(o != "none", o)),
    )
    entry = F.concat(
        F.lit("["), F.col("score").cast("string"), F.lit(","), F.to_json(F.split("logic_pipe", "_")),
        F.lit(","), F.to_json(ops), F.lit("]"),
    )
    # at most five entries per data set by construction of the view
    five = F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"])
    whole = rec.groupBy("dataset").agg(five.alias("es"))
    return whole.select(
        F.concat(F.lit('{"'), F.col("dataset"), F.lit('":['), F.concat_ws(",", "es"), F.lit("]}")).alias("value")
    )


def recorded(spark, sf):
    return tables.parse_sequences(recorded_json(spark, sf))


@query(
    "recorded_parse",
    with_views(["recorded"], f"SELECT dataset, pos, score, {TXT_ORDER} AS step_order, {TXT_OPS} AS ops FROM sq", SEQ),
)
def recorded_parse(spark, sf):
    return text(recorded(spark, sf))


NAMES = ["Brand#1", "Brand#12", "Brand#25", "no such set"]
IN_NAMES = "('" + "', '".join(NAMES) + "')"


@query(
    "trials_for_datasets",
    with_views(["trials"], f"SELECT dataset, trial_id, logic_pipe, phy_pipe, accuracy FROM trials WHERE dataset IN {IN_NAMES}"),
)
def trials_for_datasets(spark, sf):
    return TR.for_datasets(view(spark, sf, "trials"), NAMES)


@query(
    "recorded_resolve_metric",
    with_views(["trials"], """SELECT model, metric, count(*) AS n FROM (
      SELECT CASE trial_id % 3 WHEN 0 THEN 'KNN' WHEN 1 THEN 'SVM' ELSE 'DecisionTree' END AS model,
             CASE WHEN trial_id % 3 = 0 AND trial_id % 2 = 0 THEN 'f1_macro' ELSE 'accuracy' END AS metric FROM trials) x
      WHERE (model = 'KNN' AND metric = 'f1_macro') OR (model = 'SVM' AND metric = 'accuracy') GROUP BY model, metric"""),
)
def recorded_resolve_metric(spark, sf):
    """KNN has its own f1 history; SVM falls back to accuracy."""
    t = view(spark, sf, "trials")
    m = F.when(F.col("trial_id") % 3 == 0, "KNN").when(F.col("trial_id") % 3 == 1, "SVM").otherwise("DecisionTree")
    own = (F.col("trial_id") % 3 == 0) & (F.col("trial_id") % 2 == 0)
    base = t.withColumn("model", m).withColumn("metric", F.when(own, "f1_macro").otherwise("accuracy"))
    both = K.resolve_metric(base, "KNN", "f1_macro").unionByName(K.resolve_metric(base, "SVM", "f1_macro"))
    return both.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n"))


# the table at hand needs imputing and encoding, not outlier masking
CLEAN = SEQ + """,
cl AS (SELECT dataset, pos, score,
   list_concat(['I'], list_filter(steps, lambda s: s <> 'O' AND s <> 'FS')) AS steps,
   list_concat([ops[1]], list_transform(list_filter(list_zip(steps, ops[2:]), lambda p: p[1] <> 'O' AND p[1] <> 'FS'), lambda p: p[2])) AS ops
 FROM sq)"""


def cleaned(spark, sf):
    return K.clean_sequences(recorded(spark, sf), need_i=True, need_o=False, need_e=True)


@query(
    "clean_sequences",
    with_views(["recorded"], f"SELECT dataset, pos, score, {TXT_ORDER} AS step_order, {TXT_OPS} AS ops FROM cl", CLEAN),
)
def clean_sequences(spark, sf):
    return text(cleaned(spark, sf))


@query(
    "dedupe_sequences",
    with_views(["recorded"], "SELECT step_order, ops, arg_min(dataset, {'d': dataset, 'p': pos}) AS dataset,"
               " arg_min(pos, {'d': dataset, 'p': pos}) AS pos, count(*) AS n FROM"
               f" (SELECT dataset, pos, {TXT_ORDER} AS step_order, {TXT_OPS} AS ops FROM cl) x GROUP BY step_order, ops", CLEAN),
)
def dedupe_sequences(spark, sf):
    return text(K.distinct_sequences(cleaned(spark, sf)))


@query(
    "order_sources",
    with_views(["recorded"], f"""SELECT step_order, array_to_string(list_sort(list(DISTINCT dataset)), ',') AS sources
      FROM (SELECT dataset, {TXT_ORDER} AS step_order FROM cl) x GROUP BY step_order""", CLEAN),
)
def order_sources(spark, sf):
    out = K.order_sources(cleaned(spark, sf))
    return out.select(F.concat_ws(",", "step_order").alias("step_order"), F.concat_ws(",", "sources").alias("sources"))


DEFAULTS = CLEAN + """,
dq AS (SELECT steps, ops, arg_min(pos, {'d': dataset, 'p': pos}) AS pos FROM cl GROUP BY steps, ops),
lo AS (SELECT pos, unnest(steps) AS step, unnest(ops) AS op FROM dq),
us AS (SELECT step, op, count(*) AS n, min(pos) AS pos FROM lo WHERE op IS NOT NULL GROUP BY step, op),
de AS (SELECT step, op, n FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, pos, op) AS k FROM us) z WHERE k = 1)"""


@query("default_ops", with_views(["recorded"], "SELECT step, op, n FROM de", DEFAULTS))
def default_ops(spark, sf):
    return K.default_operators(K.distinct_sequences(cleaned(spark, sf)))


CAND = DEFAULTS + """,
orders_ AS (SELECT array_to_string(steps, ',') AS step_order, any_value(steps) AS steps, count(*) AS n FROM dq GROUP BY 1),
ca AS (SELECT step_order, string_agg(d.op, ',' ORDER BY i) AS ops, any_value(n) AS n FROM (
   SELECT step_order, n, unnest(steps) AS step, generate_subscripts(steps, 1) AS i FROM orders_) o
   JOIN (SELECT step, op FROM de) d ON o.step = d.step GROUP BY step_order)"""


@query("candidate_sequences", with_views(["recorded"], "SELECT step_order, ops, n FROM ca", CAND))
def candidate_sequences(spark, sf):
    return text(K.candidates(K.distinct_sequences(cleaned(spark, sf))))


@query(
    "sequence_config",
    with_views(["recorded"], """SELECT step_order, step, method,
      CASE step WHEN 'O' THEN 'threshold=3' WHEN 'FT' THEN 'n_components=2'
           WHEN 'FS' THEN 'var_threshold=0,pearson_threshold=0.1' ELSE '' END AS params
      FROM (SELECT step_order, unnest(string_split(step_order, ',')) AS step, unnest(string_split(ops, ',')) AS method FROM ca) x""", CAND),
)
def sequence_config(spark, sf):
    out = K.sequence_config(K.candidates(K.distinct_sequences(cleaned(spark, sf))))
    flat = out.select(F.concat_ws(",", "step_order").alias("step_order"), F.explode("config").alias("c"))
    params = F.concat_ws(",", F.transform(F.map_entries("c.params"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return flat.select("step_order", "c.step", "c.method", params.alias("params"))


# ---------------------------------------------------------------- similar data sets

MEASURES = (
    "n_instances", "n_features", "n_num_features", "n_cat_features", "missing_ratio", "feature_mean_skew",
    "feature_mean_kurtosis", "mean_feature_variance", "mean_feature_correlation", "target_num_classes", "target_entropy",
    "mean_mutual_info", "max_mutual_info",
)


def measure_views(source: str, by: str, tag: str) -> str:
    """Views that end in <tag>_ms: one row of measures per data set."""
    from catalog.profiles import CENTRED, NUM, mutual_sql

    num = "num AS (" + " UNION ALL ".join(f"SELECT {by} || '|{c}' AS feature, {c} AS value FROM {source}" for c in NUM) + ")"
    text_ = num + "," + CENTRED + f", cors AS ({corr_sql(source, by)})"
    for n in ("num", "mid", "pow", "mom", "cors"):
        text_ = text_.replace(f"{n} AS (", f"{tag}_{n} AS (").replace(f"FROM {n} ", f"FROM {tag}_{n} ").replace(
            f"JOIN {n} ", f"JOIN {tag}_{n} ").replace(f"FROM {n})", f"FROM {tag}_{n})")
    return text_ + ", " + mutual_sql(source, by, tag) + f""", {tag}_ms AS (SELECT s.*, m.sk AS feature_mean_skew, m.ku AS feature_mean_kurtosis,
      m.va AS mean_feature_variance, c.co AS mean_feature_correlation, e.target_num_classes, e.te AS target_entropy,
      i.mean_mutual_info, i.max_mutual_info
    FROM (SELECT {by} AS dataset, count(*) AS n_instances, 7 AS n_features, 5 AS n_num_features,
                 2 AS n_cat_features, {MISSING} AS missing_ratio FROM {source} GROUP BY {by}) s
    JOIN (SELECT split_part(feature, '|', 1) AS dataset, avg(skew) AS sk, avg(kurt) AS ku, avg(v) AS va FROM {tag}_mom GROUP BY 1) m
      ON s.dataset = m.dataset
    JOIN (SELECT {by} AS dataset, avg(r) AS co FROM {tag}_cors GROUP BY {by}) c ON s.dataset = c.dataset
    JOIN (SELECT {by} AS dataset, count(*) AS target_num_classes, {ENTROPY} AS te FROM (
            SELECT {by}, count(*) / sum(count(*)) OVER (PARTITION BY {by}) AS p FROM {source} GROUP BY {by}, label) w
          GROUP BY {by}) e ON s.dataset = e.dataset JOIN {tag}_mi i ON s.dataset = i.dataset)"""


def _near_sql(queries: str, leave_out: bool) -> str:
    """queries: a view with one row of measures per query, named by dataset."""
    # pool of each query, with a query's own row left out before means and spreads
    cond = "k.dataset <> q.dataset" if leave_out else "TRUE"
    stats = ", ".join(f"avg(k.{m}) AS a_{m}, stddev_pop(k.{m}) AS s_{m}, max(k.{m}) AS h_{m}, min(k.{m}) AS l_{m}" for m in MEASURES)
    z = lambda t, m: f"(({t}.{m} - s.a_{m}) / CASE WHEN s.h_{m} > s.l_{m} THEN s.s_{m} ELSE 1 END)"
    dot = " + ".join(f"{z('k', m)} * {z('q', m)}" for m in MEASURES)
    nk = " + ".join(f"{z('k', m)} * {z('k', m)}" for m in MEASURES)
    nq = " + ".join(f"{z('q', m)} * {z('q', m)}" for m in MEASURES)
    return f"""SELECT query, dataset, {r('similarity')} AS similarity, CAST(place AS INT) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, dataset) AS place FROM (
        SELECT q.dataset AS query, k.dataset, coalesce(({dot}) / nullif(sqrt({nk}) * sqrt({nq}), 0), 0) AS similarity
        FROM {queries} q JOIN kb_ms k ON {cond} JOIN (
          SELECT q.dataset AS sq, {stats} FROM {queries} q JOIN kb_ms k ON {cond} GROUP BY q.dataset) s ON s.sq = q.dataset) y) x
      WHERE place <= 5"""


WHOLE = "whole AS (SELECT 'all' AS dataset, * FROM ds)"


@query(
    "nearest_datasets",
    with_views(["ds", "kb"], _near_sql("all_ms", False), WHOLE + ", " + measure_views("kb", "dataset", "kb") + ", " + measure_views("whole", "dataset", "all")),
)
def nearest_datasets(spark, sf):
    """The whole table against the 25 tables it is made of."""
    kb = profile.table_measures(view(spark, sf, "kb"), ["dataset"])
    me = profile.table_measures(view(spark, sf, "ds")).withColumn("dataset", F.lit("all"))
    return rounded(K.nearest_datasets(kb, me))


@query("nearest_datasets_leave_out", with_views(["kb"], _near_sql("kb_ms", True), measure_views("kb", "dataset", "kb")))
def nearest_datasets_leave_out(spark, sf):
    """Every data set against all others."""
    kb = profile.table_measures(view(spark, sf, "kb"), ["dataset"])
    return rounded(K.nearest_datasets(kb, kb))


def _renamed(df):
    """Recorded sets are brands; a nation's number picks the brand of the same number."""
    return df.withColumn("dataset", F.regexp_replace("dataset", "Brand#", ""))


@query(
    "recommend_sequences",
    with_views(["ds", "kb", "recorded"], f"""SELECT n.query, n.place, n.dataset, s.pos, s.score,
        CASE WHEN s.ops IS NOT NULL THEN 'I,' || {TXT_ORDER} ELSE '' END AS step_order, coalesce({TXT_OPS}, '') AS ops
      FROM ({_near_sql('all_ms', False)}) n LEFT JOIN sq s ON s.dataset = 'Brand#' || n.dataset""",
      WHOLE + ", " + measure_views("kb", "dataset", "kb") + ", " + measure_views("whole", "dataset", "all") + ", " + SEQ),
)
def recommend_sequences(spark, sf):
    kb = profile.table_measures(view(spark, sf, "kb"), ["dataset"])
    me = profile.table_measures(view(spark, sf, "ds")).withColumn("dataset", F.lit("all"))
    out = K.recommend(K.nearest_datasets(kb, me), _renamed(recorded(spark, sf)))
    return text(out)


# ---------------------------------------------------------------- trials


@query(
    "topk_trials",
    with_views(["trials"], "SELECT trial_id, dataset, accuracy FROM trials ORDER BY accuracy DESC, trial_id LIMIT 100"),
)
def topk_trials(spark, sf):
    return TR.top_trials(view(spark, sf, "trials"), 100).select("trial_id", "dataset", "accuracy")


WEIGHTED = "lf AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce({c}, 'none') AS method, accuracy AS w FROM colstrat" for c in ("f_price", "f_acctbal")
) + ")"


@query(
    "strategy_freq_weighted",
    with_views(["colstrat"], "SELECT feature, " + ", ".join(
        f"{r(f'''coalesce(sum(w) FILTER (method = '{m}'), 0)''')} AS {m}" for m in METHODS) + " FROM lf GROUP BY feature", WEIGHTED),
)
def strategy_freq_weighted(spark, sf):
    return rounded(TR.strategy_frequency(view(spark, sf, "colstrat"), ["f_price", "f_acctbal"]))


def _softmax_sql():
    from catalog.profiles import STRATEGY

    return with_views(["colstrat"], "SELECT feature, " + ", ".join(f"{r(f'{m} / t')} AS {m}" for m in METHODS) + " FROM nm", STRATEGY)


@query("strategy_freq_softmax", _softmax_sql())
def strategy_freq_softmax(spark, sf):
    return rounded(TR.strategy_frequency_ranked(view(spark, sf, "colstrat"), ["f_price", "f_acctbal"], 100))


TARGET = ["E", "N", "FT"]
PROJECTED = """lp AS (SELECT *, string_split(logic_pipe, '_') AS l, string_split(phy_pipe, '_') AS p FROM trials),
pj AS (SELECT dataset, trial_id, accuracy, list_filter(l, lambda s: list_contains(['E', 'N', 'FT'], s)) AS logic,
         list_filter(['E', 'N', 'FT'], lambda s: list_contains(l, s)) AS want, l, p FROM lp),
pr AS (SELECT dataset, trial_id, accuracy, logic,
         list_transform(logic, lambda s: p[least(list_position(l, s), len(p))]) AS phy FROM pj WHERE len(logic) > 0 AND logic = want)"""


@query(
    "sequence_project",
    with_views(["trials"], "SELECT dataset, trial_id, accuracy, array_to_string(logic, ',') AS logic, array_to_string(phy, ',') AS phy FROM pr", PROJECTED),
)
def sequence_project(spark, sf):
    out = TR.project_on(view(spark, sf, "trials"), TARGET)
    return out.withColumn("logic", F.concat_ws(",", "logic")).withColumn("phy", F.concat_ws(",", "phy"))


EDGES = PROJECTED + """,
best AS (SELECT * FROM pr WHERE dataset IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') ORDER BY accuracy DESC, trial_id LIMIT 50),
ed AS (SELECT accuracy, unnest(list_zip(list_concat(['__START__'], phy[1:len(phy) - 1]), phy)) AS e FROM best),
tt AS (SELECT e[1] AS prev, e[2] AS next, max(accuracy) AS score FROM ed GROUP BY 1, 2)"""
SETS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]


@query("transition_table", with_views(["trials"], 'SELECT prev, next, score FROM tt', EDGES))
def transition_table(spark, sf):
    return TR.transition_table(view(spark, sf, "trials"), SETS, TARGET, 50)


UPDATED = EDGES + """,
sb AS (SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ledger),
ue AS (SELECT score - b AS d, unnest(list_zip(list_concat(['__START__'], ops[1:len(ops) - 1]), ops)) AS e FROM sb WHERE b IS NOT NULL),
uu AS (SELECT prev, next, sum(score) AS score FROM (SELECT prev, next, score FROM tt
       UNION ALL SELECT e[1], e[2], d FROM ue WHERE e[1] <> '__START__' OR d > 0) x GROUP BY prev, next)"""


def updated(spark, sf):
    return TR.transition_update(transition_table(spark, sf), view(spark, sf, "ledger"))


@query("transition_update", with_views(["trials", "ledger"], f"SELECT prev, next, {r('score')} AS score FROM uu", UPDATED))
def transition_update(spark, sf):
    return rounded(updated(spark, sf))


@query(
    "choice_weights",
    with_views(["trials"], f"""SELECT prev, next, {r('CASE WHEN lo = hi THEN 1.0 / n ELSE e / te END')} AS weight FROM (
      SELECT prev, next, e, sum(e) OVER (PARTITION BY prev) AS te, lo, hi, n FROM (
        SELECT prev, next, exp((score - max(score) OVER w) / 0.5) AS e, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n
        FROM tt WINDOW w AS (PARTITION BY prev)) a) b""", EDGES),
)
def choice_weights(spark, sf):
    return rounded(TR.choice_weights(transition_table(spark, sf)))


@query("choice_draw")
def choice_draw(spark, sf):
    return TR.draw_choice(TR.choice_weights(transition_table(spark, sf)), seed=0, round_no=1)


# ---------------------------------------------------------------- search log


@query(
    "prefix_ucb",
    with_views(["ledger"], f"""SELECT c.run_id, c.prefix, CAST(c.depth AS INT) AS depth, c.visits, c.best_score, p.visits AS parent_visits,
      {r('c.best_score + 2 * sqrt(ln(p.visits) / c.visits)')} AS ucb
      FROM st c JOIN st p ON c.run_id = p.run_id AND c.parent = p.prefix AND c.depth = p.depth + 1""",
      """px AS (SELECT run_id, score, ops, unnest(range(0, len(ops) + 1)) AS depth FROM ledger),
      st AS (SELECT run_id, array_to_string(ops[1:depth], '>') AS prefix, CASE WHEN depth = 0 THEN '' ELSE array_to_string(ops[1:depth - 1], '>') END AS parent, depth,
             count(*) AS visits, greatest(max(score), 0.0) AS best_score FROM px GROUP BY 1, 2, 3, 4)"""),
)
def prefix_ucb(spark, sf):
    return rounded(L.prefix_scores(view(spark, sf, "ledger")), ["ucb"])


RUNNING = """rb AS (SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ledger),
im AS (SELECT *, b IS NULL OR score > b AS improved, row_number() OVER (PARTITION BY run_id ORDER BY iteration) AS n FROM rb),
la AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY run_id ORDER BY iteration) AS no_improve,
       max(CASE WHEN improved THEN iteration END) OVER (PARTITION BY run_id ORDER BY iteration) AS bi FROM im)"""


@query(
    "ledger_running_best",
    with_views(["ledger"], "SELECT run_id, iteration, score, greatest(b, score) AS best_score, improved, no_improve FROM la", RUNNING),
)
def ledger_running_best(spark, sf):
    return L.running_best(view(spark, sf, "ledger")).drop("step_order", "ops")


@query(
    "global_curve",
    with_views(["ledger"], """SELECT iteration, global_best_score, run_id, best_order, best_ops FROM (
      SELECT l.iteration, i.score AS global_best_score, l.run_id, i.step_order AS best_order, array_to_string(i.ops, ',') AS best_ops,
             row_number() OVER (PARTITION BY l.iteration ORDER BY i.score DESC, l.run_id) AS k
      FROM la l JOIN ledger i ON i.run_id = l.run_id AND i.iteration = l.bi) x WHERE k = 1""", RUNNING),
)
def global_curve(spark, sf):
    out = L.global_curve(view(spark, sf, "ledger"))
    return out.withColumn("best_ops", F.concat_ws(",", "best_ops"))


@query(
    "finalists",
    with_views(["ledger"], """SELECT step_order, ops, best_score FROM (SELECT *, max(best_score) OVER () AS m FROM (
      SELECT step_order, array_to_string(ops, ',') AS ops, max(score) AS best_score FROM im WHERE improved GROUP BY 1, 2
      ORDER BY best_score DESC, step_order, ops LIMIT 5) x) y WHERE best_score >= m - 0.01""", RUNNING),
)
def finalists(spark, sf):
    return L.finalists(view(spark, sf, "ledger")).withColumn("ops", F.concat_ws(",", "ops"))


SPACE_ROWS = ", ".join(
    f"('{m}', '{step}', '{op}', {i})"
    for m in sorted(K.NARROWED)
    for step, ops in K.allowed(m).items()
    for i, op in enumerate(ops)
)
SPACE = f"space AS (SELECT * FROM (VALUES {SPACE_ROWS}) v(model, step, op, ord))"
USED = SPACE + """,
used AS (SELECT step, op, count(*) AS n, max(accuracy) AS top FROM (
   SELECT unnest(string_split(logic_pipe, '_')) AS step, unnest(string_split(phy_pipe, '_')) AS op, accuracy FROM trials) u GROUP BY step, op)"""


@query(
    "operator_space",
    with_views(["trials"], """SELECT s.model, s.step, s.op, CAST(s.ord AS INT) AS ord, coalesce(u.n, 0) AS trials, u.top AS best_accuracy
      FROM space s LEFT JOIN used u ON s.step = u.step AND s.op = u.op""", USED),
)
def operator_space(spark, sf):
    """Allowed operators per model with how often and how well each was tried."""
    t = view(spark, sf, "trials")
    pairs = F.arrays_zip(F.split("logic_pipe", "_").alias("s"), F.split("phy_pipe", "_").alias("o"))
    used = t.select("accuracy", F.explode(pairs).alias("e")).groupBy(F.col("e.s").alias("step"), F.col("e.o").alias("op")).agg(
        F.count(F.lit(1)).alias("n"), F.max("accuracy").alias("best_accuracy"))
    out = K.operator_space(spark).join(used, ["step", "op"], "left")
    return out.select("model", "step", "op", "ord", F.coalesce("n", F.lit(0)).alias("trials"), "best_accuracy")


@query(
    "untried_ops",
    with_views(["ledger"], """SELECT DISTINCT n.step_order, n.prefix, s.step, s.op FROM no n JOIN space s ON s.step = n.step AND s.model = 'SVM'
      WHERE NOT EXISTS (SELECT 1 FROM no t WHERE t.step_order = n.step_order AND t.prefix = n.prefix AND t.op = s.op)""",
      SPACE + """, dx AS (SELECT step_order, ops, unnest(range(0, len(ops))) AS d FROM ledger),
      no AS (SELECT DISTINCT step_order, array_to_string(ops[1:d], '>') AS prefix, string_split(step_order, '_')[d + 1] AS step, ops[d + 1] AS op FROM dx)"""),
)
def untried_ops(spark, sf):
    return L.untried(view(spark, sf, "ledger"), K.operator_space(spark, ["SVM"]))


LOOKUP = ", ".join(f"({v}, '{k}')" for k, v in K.DATASET_IDS.items())


@query(
    "dataset_lookup",
    f"""SELECT p.p_partkey, p.p_brand, v.name AS dataset_name FROM part p
        LEFT JOIN (VALUES {LOOKUP}) v(id, name) ON p.p_partkey = v.id""",
)
def dataset_lookup(spark, sf):
    return K.dataset_lookup(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
