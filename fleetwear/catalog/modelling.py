"""Model matrix, metrics and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwear.catalog.features import WEEKLY_SQL, all_inputs, rounded
from fleetwear.catalog.registry import query
from fleetwear.catalog.roles import FIRST, LAST, SCORED, maintenance, scored
from fleetwear.operators import evaluate, models, prepare, profile
from fleetwear.operators.correlation import corr_matrix, corr_target
from fleetwear.plans.features import (
    KEYS,
    LABEL,
    MAINTENANCE_FEATURES,
    STATUS_FEATURES,
    USAGE_FEATURES,
    weekly_features,
)
from fleetwear.session import stage

# The battery state becomes a flag before modelling.
MODEL_COLUMNS = (
    *USAGE_FEATURES, *MAINTENANCE_FEATURES,
    *(c for c in STATUS_FEATURES if c != "battery_health_last"), "battery_aging",
)

GOLD = f"gold as ({WEEKLY_SQL})"
_SPLIT = """cut as (
  select min(d) as cutoff from (select distinct feature_date as d from gold order by d desc limit 4)),
marked as (select g.*, feature_date >= cutoff as is_test from gold g, cut)"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def gold(t):
    return rounded(weekly_features(all_inputs(t), FIRST, LAST))


def labels(t):
    """The rows of ``gold`` with their labels only."""
    return weekly_features(all_inputs(t), FIRST, LAST, columns=[*KEYS, LABEL])


@query("class_balance", _with(GOLD) + f"""select {LABEL}, count(*) as n,
  count(*) * 100::double / sum(count(*)) over () as pct from gold group by 1""")
def class_balance(t):
    return profile.share(labels(t), [LABEL])


@query("positive_rate", _with(GOLD) + f"""select serial_number, feature_date, avg({LABEL}) as positive_rate
from gold group by grouping sets ((serial_number), (feature_date))""")
def positive_rate(t):
    serial, date = F.col("serial_number"), F.col("feature_date")
    sets = labels(t).groupingSets([[serial], [date]], serial, date)
    return sets.agg(F.avg(LABEL).alias("positive_rate"))


@query("gold_postprocess", _with(GOLD) + """select * exclude (battery_health_last, brush_residual_last,
    filter_residual_last, squeegee_residual_last),
  coalesce(battery_health_last = 'AGING', false)::int as battery_aging,
  coalesce(brush_residual_last::double, 100) as brush_residual_last,
  coalesce(filter_residual_last::double, 100) as filter_residual_last,
  coalesce(squeegee_residual_last::double, 100) as squeegee_residual_last from gold""")
def gold_postprocess(t):
    return prepare.postprocess(gold(t))


@query("temporal_split", _with(GOLD, _SPLIT) + f"select serial_number, feature_date, {LABEL}, is_test from marked")
def temporal_split(t):
    return prepare.with_split(stage(labels(t), "labels")).select(*KEYS, LABEL, "is_test")


_READY = f"""ready as (select * exclude (battery_health_last, brush_residual_last, filter_residual_last,
    squeegee_residual_last), coalesce(battery_health_last = 'AGING', false)::int as battery_aging,
  coalesce(brush_residual_last::double, 100) as brush_residual_last,
  coalesce(filter_residual_last::double, 100) as filter_residual_last,
  coalesce(squeegee_residual_last::double, 100) as squeegee_residual_last from marked),
middle as (select {", ".join(f"coalesce(quantile_cont({c}::double, 0.5), 0) as {c}" for c in MODEL_COLUMNS)}
  from ready where not is_test),
filled as (select serial_number, feature_date, is_test, {LABEL},
  {", ".join(f"coalesce(r.{c}::double, middle.{c}) as {c}" for c in MODEL_COLUMNS)} from ready r, middle)"""
_FILLED = _with(GOLD, _SPLIT, _READY)


@query("impute_median", _FILLED + "select serial_number, feature_date, " + ", ".join(
    f"round({c}, 8) as {c}" for c in MODEL_COLUMNS
) + " from filled")
def impute_median(t):
    rows = _matrix(t)
    train, _ = prepare.temporal_split(rows)
    filled = prepare.impute(rows, prepare.fit_medians(train, MODEL_COLUMNS))
    return filled.select(*KEYS, *[F.round(c, 8).alias(c) for c in MODEL_COLUMNS])


@query("standardize", _with(GOLD, _SPLIT, _READY, "fit as (select " + ", ".join(
    f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in MODEL_COLUMNS
) + " from filled where not is_test)") + "select serial_number, feature_date, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) + 0.0::double as {c}" for c in MODEL_COLUMNS
) + " from filled, fit")
def standardize(t):
    rows = _matrix(t)
    train, _ = prepare.temporal_split(rows)
    fills = prepare.fit_medians(train, MODEL_COLUMNS)
    scaling = prepare.fit_scaling(prepare.impute(train, fills), MODEL_COLUMNS)
    scaled = prepare.standardize(prepare.impute(rows, fills), scaling)
    return scaled.select(*KEYS, *[(F.round(c, 6) + 0.0).alias(c) for c in MODEL_COLUMNS])


@query("null_profile", _with(GOLD) + " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as n_missing from gold"
    for c in (*KEYS, *USAGE_FEATURES, *MAINTENANCE_FEATURES, *STATUS_FEATURES, LABEL)
))
def null_profile(t):
    rows = gold(t)
    return profile.null_profile(rows, rows.columns)


@query("stratified_folds", _with(GOLD, f"sizes as (select {LABEL}, count(*) as n from gold group by 1)") + f"""
select {LABEL}, f::int as fold, n // 5 + (f < n % 5)::int as n_rows from sizes, range(5) r(f)""")
def stratified_folds(t):
    folded = prepare.stratified_folds(stage(labels(t), "labels"), LABEL, KEYS)
    return profile.profile(folded, [LABEL, "fold"], n_rows=F.count(F.lit(1)))


# ----------------------------------------------------------------- metrics

_RANKED = """counts as (select score, sum(label) as pos, sum(1 - label) as neg from scored group by 1),
up as (select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg,
    sum(pos) over () as p, sum(neg) over () as n
  from counts window w as (order by score desc))"""
_RANKS = _with(SCORED, _RANKED)


@query("roc_auc", _with(SCORED, """ranks as (
  select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2::double as r
  from scored)""") + """select round((sum(r) filter (where label = 1) - p * (p + 1) / 2) / (p * n), 9) as roc_auc
from ranks, (select sum(label)::double as p, sum(1 - label)::double as n from scored) group by p, n""")
def roc_auc(t):
    return evaluate.roc_auc(scored(t), "score", "label").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("average_precision", _RANKS + """select round(sum(pos / p::double * (cum_pos / (cum_pos + cum_neg)::double)), 9)
  as average_precision from up""")
def average_precision(t):
    rows = evaluate.average_precision(scored(t), "score", "label")
    return rows.select(F.round("average_precision", 9).alias("average_precision"))


@query("roc_curve", _RANKS + """select score as threshold, cum_neg / n::double as fpr, cum_pos / p::double as tpr from up
union all select null, 0, 0""")
def roc_curve(t):
    return evaluate.roc_curve(scored(t), "score", "label")


@query("pr_curve", _RANKS + """select score as threshold, cum_pos / (cum_pos + cum_neg)::double as precision,
  cum_pos / p::double as recall, p / (p + n)::double as base_rate from up
union all select null, 1, 0, avg(label) from scored""")
def pr_curve(t):
    return evaluate.pr_curve(scored(t), "score", "label")


_CELLS = """cells as (select count(*) filter (where label = 0 and score <= 0.5) as tn,
  count(*) filter (where label = 0 and score > 0.5) as fp,
  count(*) filter (where label = 1 and score <= 0.5) as fn,
  count(*) filter (where label = 1 and score > 0.5) as tp from scored)"""


@query("confusion_matrix", _with(SCORED, _CELLS) + """select 0 as label, 0 as predicted, tn as n from cells
union all select 0, 1, fp from cells union all select 1, 0, fn from cells union all select 1, 1, tp from cells""")
def confusion_matrix(t):
    return evaluate.confusion(scored(t), "score", "label")


@query("classification_report", _with(SCORED, _CELLS, """m as (select *, tn + fp as s0, tp + fn as s1,
  tn / (tn + fn)::double as p0, tn / (tn + fp)::double as r0,
  tp / (tp + fp)::double as p1, tp / (tp + fn)::double as r1 from cells)""", """f as (
  select *, p0 * r0 * 2 / (p0 + r0) as f0, p1 * r1 * 2 / (p1 + r1) as f1, s0 + s1 as n from m)""", """r as (
  select '0' as class, p0 as precision, r0 as recall, f0 as f1, s0 as support from f
  union all select '1', p1, r1, f1, s1 from f
  union all select 'accuracy', null, null, (tn + tp) / n::double, n from f
  union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from f
  union all select 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n
  from f)""") + """select class, round(precision, 9) as precision, round(recall, 9) as recall,
  round(f1, 9) as f1, support from r""")
def classification_report(t):
    rows = evaluate.classification_report(scored(t), "score", "label")
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_GRID = ", ".join(repr(v) for v in evaluate.threshold_grid())
_SWEEP = _with(SCORED, f"""grid as (
  select unnest([{_GRID}]::double[]) as threshold)""", """base as (
  select threshold, count(*) filter (where score >= threshold and label = 1) as tp,
    count(*) filter (where score >= threshold and label = 0) as fp,
    count(*) filter (where score < threshold and label = 1) as fn,
    count(*) filter (where score < threshold and label = 0) as tn
  from grid cross join scored group by 1)""", """pr as (
  select *, case when tp + fp = 0 then 0 else tp / (tp + fp)::double end as precision,
    case when tp + fn = 0 then 0 else tp / (tp + fn)::double end as recall from base)""", """sweep as (
  select *, case when precision + recall = 0 then 0 else precision * recall * 2 / (precision + recall) end as f1,
    tp * 239 - fp * 60 - fn * 239 as net_saving from pr)""")


@query("threshold_sweep", _SWEEP + "select * from sweep")
def threshold_sweep(t):
    return evaluate.threshold_sweep(scored(t), "score", "label")


@query("best_threshold", _SWEEP + """select threshold, tp, fp, fn, tn, net_saving,
  tp * 239 / 60::double as prevented_h, fp * 60 / 60::double as checks_h,
  fn * 239 / 60::double as missed_h, net_saving / 60::double as net_h
from sweep order by net_saving desc, threshold limit 1""")
def best_threshold(t):
    return evaluate.best_threshold(evaluate.threshold_sweep(scored(t), "score", "label"))


_DATED = """dated as (select event_id, value / (value + 50.0) as score, (event_type = 'error')::int as label,
    dense_rank() over (order by ts::date desc) as back from events)"""


_ON_VALID = _SWEEP.replace(SCORED, f"{_DATED},\nscored as (select * from dated where back between 5 and 8)").rstrip()


@query("threshold_holdout", _ON_VALID + """,
best as (select threshold, net_saving from sweep order by net_saving desc, threshold limit 1),
cells as (select threshold, best.net_saving as valid_saving, count(*) filter (where score >= threshold and label = 1) as tp,
  count(*) filter (where score >= threshold and label = 0) as fp, count(*) filter (where score < threshold and label = 1) as fn,
  count(*) filter (where score < threshold and label = 0) as tn from dated, best where back <= 4 group by all)
select *, tp * 239 - fp * 60 - fn * 239 as net_saving, (tp * 239 - fp * 60 - fn * 239) / 60::double as net_h from cells""")
def threshold_holdout(t):
    """Chosen on four days, judged on the four after them."""
    rows = scored(t).join(t.events.select("event_id", F.to_date("ts").alias("day")), "event_id")
    parts = prepare.three_way_split(rows, "day")
    return evaluate.held_out_threshold(parts.where("part = 'valid'"), parts.where("part = 'test'"), "score", "label")


@query("label_frontier", _with(GOLD) + f"""select serial_number, feature_date, {LABEL}, feature_date + 30 <= reached as label_complete
from gold, (select max(l_shipdate::date) as reached from lineitem where l_returnflag = 'R')""")
def label_frontier(t):
    reached = prepare.frontier(maintenance(t), "completed_at")
    return prepare.with_label_complete(labels(t), reached).select(*KEYS, LABEL, "label_complete")


@query("complete_split", _with(GOLD, """known as (
  select g.* from gold g, (select max(l_shipdate::date) as reached from lineitem where l_returnflag = 'R') where feature_date + 30 <= reached)""",
  """cut as (select min(d) as cutoff from (select distinct feature_date as d from known order by d desc limit 4))""")
  + f"select serial_number, feature_date, {LABEL}, feature_date >= cutoff as is_test from known, cut")
def complete_split(t):
    """Training and test rows when labels that are not decided yet are left out of both."""
    rows = prepare.with_label_complete(stage(labels(t), "labels"), prepare.frontier(maintenance(t), "completed_at"))
    return prepare.with_split(rows.where("label_complete")).select(*KEYS, LABEL, "is_test")


# ------------------------------------------------------------- classifiers


def _matrix(t):
    return stage(prepare.postprocess(gold(t)), "matrix")


def _filled_train(t):
    train, _ = prepare.temporal_split(_matrix(t))
    return prepare.impute(train, prepare.fit_medians(train, MODEL_COLUMNS))


@query("corr_features", _with(GOLD, _SPLIT, _READY, "c as (" + " union all ".join(
    f"select '{c}' as column_name, coalesce(round(corr({c}, {LABEL}), 6), 0) as r from filled where not is_test"
    for c in MODEL_COLUMNS
) + ")") + "select * from c order by abs(r) desc, column_name limit 5")
def corr_features(t):
    ranked = corr_target(_filled_train(t), MODEL_COLUMNS, LABEL)
    # Ties in the rounded value go by name, as the report shows them.
    rounded_r = ranked.withColumn("r", F.coalesce(F.round("r", 6), F.lit(0.0)) + 0.0)
    return rounded_r.orderBy(F.abs("r").desc(), "column_name").limit(5)


_PAIRED = (*MODEL_COLUMNS, LABEL)


@query("corr_matrix_features", _FILLED + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, coalesce(round(corr({a}, {b}), 6), 0) as r from filled where not is_test"
    for a in _PAIRED for b in _PAIRED
))
def corr_matrix_features(t):
    rows = corr_matrix(_filled_train(t), _PAIRED)
    return rows.withColumn("r", F.coalesce(F.round("r", 6), F.lit(0.0)) + 0.0)


def _split(t):
    return prepare.temporal_split(_matrix(t))


def _fit_lr(train):
    return models.fit_lr(train, MODEL_COLUMNS, LABEL)


def _fit_gbt(train):
    return models.fit_gbt(train, MODEL_COLUMNS, LABEL)


_models: dict[tuple[str, str], models.Fitted] = {}


def _boosted(t, rows=None) -> models.Fitted:
    """The boosted model of a folder, fitted once an application: several queries ask about the same one.

    ``rows`` is the matrix where the query has staged it already.
    """
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _models:
        train, _ = prepare.temporal_split(_matrix(t) if rows is None else rows)
        _models[key] = _fit_gbt(train)
    return _models[key]


@query("lr_scores")
def lr_scores(t):
    train, test = _split(t)
    return models.score(_fit_lr(train), test).select(*KEYS, LABEL, "score", "predicted")


@query("lr_gradient", "select unnest(['(intercept)', " + ", ".join(f"'{c}'" for c in MODEL_COLUMNS) + """]) as column_name,
  0.0::double as gradient""")
def lr_gradient(t):
    """Every derivative of the loss vanishes at the fitted coefficients."""
    train, _ = _split(t)
    rows = models.gradient(_fit_lr(train), train, LABEL)
    return rows.withColumn("gradient", F.round("gradient", 5) + 0.0)


@query("gbt_scores")
def gbt_scores(t):
    rows = _matrix(t)
    _, test = prepare.temporal_split(rows)
    return models.score(_boosted(t, rows), test).select(*KEYS, LABEL, "score", "predicted")


_FACTS = _with(GOLD, _SPLIT) + f"""select name as model, serial_number, feature_date, {LABEL},
  true as in_range, true as follows_score, true as importance_is_one
from marked, (values ('Logistic Regression'), ('Gradient Boosting')) m(name) where is_test"""


@query("model_facts", _FACTS)
def model_facts(t):
    """What must hold for the scores of both classifiers, row by row."""
    rows = _matrix(t)
    train, test = prepare.temporal_split(rows)
    boosted = _boosted(t, rows)
    total = sum(w for _, w in models.importance(boosted))
    parts = [
        models.score(fitted, test).select(
            F.lit(name).alias("model"), *KEYS, LABEL,
            F.col("score").between(0.0, 1.0).alias("in_range"),
            (F.col("predicted") == (F.col("score") > 0.5).cast("int")).alias("follows_score"),
            F.lit(abs(total - 1) < 1e-9 or name != "Gradient Boosting").alias("importance_is_one"),
        )
        for name, fitted in (("Logistic Regression", _fit_lr(train)), ("Gradient Boosting", boosted))
    ]
    return parts[0].unionByName(parts[1])


@query("top_importance")
def top_importance(t):
    ranked = models.importance(_boosted(t))[:5]
    return t.spark.createDataFrame(ranked, "column_name string, importance double")


@query("risk_surface")
def risk_surface(t):
    rows = _matrix(t)
    return models.risk_surface(_boosted(t, rows), rows, KEYS)


@query("model_comparison")
def model_comparison(t):
    rows = _matrix(t)
    train, test = prepare.temporal_split(rows)
    fitted = {"Logistic Regression": _fit_lr(train), "Gradient Boosting": _boosted(t, rows)}
    return models.compare(fitted, test, LABEL)


# ------------------------------------------------- what the classifiers must satisfy
#
# A fitted model cannot be said in SQL. What can be said of it: the rows it
# answers for, and that its answers follow from its stored trees.


def _off(a: str, b: str):
    return (F.round(F.col(a) - F.col(b), 9) + 0.0).alias("difference")


@query("gbt_replay", _with(GOLD, _SPLIT) + f"""select serial_number, feature_date, {LABEL}, 0.0::double as difference
from marked where is_test""")
def gbt_replay(t):
    """Scores of the test rows less those that the stored node table gives."""
    rows = _matrix(t)
    fitted = _boosted(t, rows)
    scored = models.score(fitted, prepare.temporal_split(rows)[1])
    return models.replay(models.node_table(fitted), scored).select(*KEYS, LABEL, _off("score", "replayed"))


@query("gbt_trees", f"""select i::int as tree, case when i = 0 then 1.0 else {models.STEP} end::double as weight, true as rooted,
  true as within_depth, true as leaf_size, true as rows_add_up, true as gains from range({models.ROUNDS}) r(i)""")
def gbt_trees(t):
    """Every round is a tree of the given depth, weight and leaf size, whose children share their parent's rows."""
    nodes = models.node_table(_boosted(t))
    child = nodes.select("tree", F.col("node").alias("child"), F.col("n").alias("child_n"))
    inner = nodes.where(F.col("column_name").isNotNull())
    sides = inner.select("tree", "node", "n", F.explode(F.array("left_node", "right_node")).alias("child"))
    shared = sides.join(child, ["tree", "child"]).groupBy("tree", "node").agg((F.sum("child_n") == F.max("n")).alias("fits"))
    up = sides.select(F.col("tree").alias("of"), "child", F.col("node").alias("up"))
    level = nodes.select("tree", "node", F.lit(0).alias("depth")).where("node = 0")
    levels = [level]
    for _ in range(models.DEPTH):
        below = levels[-1].join(up, (F.col("of") == F.col("tree")) & (F.col("up") == F.col("node")))
        levels.append(below.select("tree", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth")))
    reached = levels[0]
    for more in levels[1:]:
        reached = reached.unionByName(more)
    met = reached.groupBy("tree").agg(F.count(F.lit(1)).alias("met"))
    leaf = F.col("column_name").isNull()
    facts = nodes.groupBy("tree").agg(
        F.max("weight").alias("weight"), F.count(F.lit(1)).alias("held"), F.bool_or(F.col("node") == 0).alias("rooted"),
        F.bool_and(F.col("n") >= models.LEAF).alias("leaf_size"), F.bool_and(leaf | (F.col("gain") >= 0)).alias("gains"),
    )
    sums = shared.groupBy("tree").agg(F.bool_and("fits").alias("fits"))
    return facts.join(met, "tree").join(sums, "tree", "left").select(
        "tree", "weight", "rooted", (F.col("met") == F.col("held")).alias("within_depth"), "leaf_size",
        F.coalesce("fits", F.lit(True)).alias("rows_add_up"), "gains",
    )


@query("gbt_importance", "select unnest([" + ", ".join(f"'{c}'" for c in MODEL_COLUMNS) + "]) as column_name, 0.0::double as difference")
def gbt_importance(t):
    """Importances of all columns less those recomputed from the gains in the node table."""
    fitted = _boosted(t)
    told = t.spark.createDataFrame(models.importance(fitted), "column_name string, importance double")
    found = models.importance_of(models.node_table(fitted)).withColumnRenamed("importance", "recomputed")
    both = told.join(found, "column_name", "full").na.fill(0.0, ["importance", "recomputed"])
    return both.select("column_name", _off("importance", "recomputed"))


@query("risk_replay", _with(GOLD) + "select serial_number, feature_date, 0.0::double as difference, true as strongest from gold")
def risk_replay(t):
    """The risk surface of all rows follows from the node table: scores, and which two columns are shown."""
    rows = _matrix(t)
    fitted = _boosted(t, rows)
    nodes = models.node_table(fitted)
    filled = models.replay(nodes, prepare.impute(rows, fitted.fills)).select(*KEYS, "replayed", *MODEL_COLUMNS)
    ranked = models.importance_of(nodes).orderBy(F.desc("importance"), "column_name").limit(2)
    top = [r["column_name"] for r in ranked.collect()]
    surface = models.risk_surface(fitted, rows, KEYS)
    strongest = (
        (F.col("feature_1") == top[0]) & (F.col("feature_2") == top[1])
        & F.col("value_1").eqNullSafe(F.col(top[0])) & F.col("value_2").eqNullSafe(F.col(top[1]))
    )
    return surface.join(filled, list(KEYS)).select(*KEYS, _off("score", "replayed"), strongest.alias("strongest"))


def _area(scored, label):
    """The area under the curve by the library's own evaluator."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = scored.select(F.col("score"), F.col(label).cast("double").alias("label"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(rows)


@query("comparison_check", "select unnest(['Logistic Regression', 'Gradient Boosting']) as model, 0.0::double as difference")
def comparison_check(t):
    """Areas of the model comparison less those of another evaluator."""
    rows = _matrix(t)
    train, test = prepare.temporal_split(rows)
    fitted = {"Logistic Regression": _fit_lr(train), "Gradient Boosting": _boosted(t, rows)}
    other = [(name, _area(models.score(f, test), LABEL)) for name, f in fitted.items()]
    told = models.compare(fitted, test, LABEL)
    return told.join(t.spark.createDataFrame(other, "model string, area double"), "model").select("model", _off("roc_auc", "area"))


def _folds(t, rows):
    return stage(prepare.stratified_folds(rows, LABEL, KEYS), "folds")


@query("cv_rows", _with(GOLD, _SPLIT) + f"""select serial_number, feature_date, {LABEL}, 1::bigint as times, true as in_range
from marked where not is_test""")
def cv_rows(t):
    """Every training row is scored once out of fold."""
    scored = models.out_of_fold(_fit_lr, _folds(t, _split(t)[0]), LABEL, KEYS)
    return scored.groupBy(*KEYS, LABEL).agg(F.count(F.lit(1)).alias("times"), F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_range"))


@query("cv_fold_areas", "select unnest(range(5))::int as fold, 0.0::double as difference")
def cv_fold_areas(t):
    """Areas of the folds less those of another evaluator on the same scores."""
    scored = models.out_of_fold(_fit_lr, _folds(t, _split(t)[0]), LABEL)
    other = [(i, _area(scored.where(F.col("fold") == i), LABEL)) for i in range(5)]
    areas = models.fold_areas(scored, LABEL)
    return areas.join(t.spark.createDataFrame(other, "fold int, area double"), "fold").select("fold", _off("roc_auc", "area"))


def _cross_validated(t, name, rows, fit, at_once=None):
    found = models.cross_validate(fit, _folds(t, rows), LABEL, at_once=at_once)
    return t.spark.createDataFrame([(name, *found)], "model string, mean_auc double, sd_auc double")


@query("cv_auc")
def cv_auc(t):
    """On the training dates."""
    return _cross_validated(t, "Logistic Regression", _split(t)[0], _fit_lr)


@query("cv_auc_gbt")
def cv_auc_gbt(t):
    """On all dates."""
    return _cross_validated(t, "Gradient Boosting", _matrix(t), _fit_gbt, models.PACKED_AT_ONCE)
