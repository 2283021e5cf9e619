"""ML queries (J1-J25, A3).  Training results are rows-only checked (tree
ensembles are randomised); metric tables over fixed prediction columns and the
OLS fit have SQL twins."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from kiln.core import ensure_checkpoint_dir, materialize
from kiln.operators import certificate, forest, ml
from kiln.operators import metrics as M
from kiln.plans.folds import contiguous_folds
from kiln.sources import io
from kiln.workloads import r, rounded, table


def _li(spark, sf):
    return table(spark, sf, "lineitem")


def _fixed_reg(spark, sf):
    li = _li(spark, sf)
    return li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("yhat"))


def _fixed_bin(spark, sf):
    li = _li(spark, sf)
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("score"),
                     F.col("l_returnflag").alias("cls"),
                     F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N")
                     .otherwise("R").alias("pred"),
                     F.col("l_tax").alias("s_n"), (F.col("l_quantity") / 50).alias("s_r"))


def _docs(spark, sf, *keep):
    """Document features joined to their quality/toxicity labels (whole tables)."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.length(F.regexp_replace("text", r"[^0-9]", "")).cast("double").alias("n_digits"),
        (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).cast("double").alias("n_lines"))
    d = d.join(table(spark, sf, "labels"), "doc_id")
    return d if "doc_id" in keep else d.drop("doc_id")


def _linreg(spark, sf):
    li = _li(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                               (F.col("l_orderkey") % 5 == 0).alias("given_test"))
    return ml.train_model(li, "l_extendedprice", "Linear Regression", ["l_quantity"], test_flag="given_test",
                          problem_type=ml.REGRESSION,
                          order_by=["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])


def _part_reg(spark, sf, name):
    p = table(spark, sf, "part").select("p_retailprice", "p_size", "p_partkey")
    return ml.train_model(p, "p_retailprice", name)


def _doc_cls(spark, sf, name, target="quality"):
    d = _docs(spark, sf)
    d = d.drop("toxic" if target == "quality" else "quality")
    return ml.train_model(d, target, name)


def _li_multiclass(spark, sf):
    li = _li(spark, sf).select("l_returnflag", "l_discount", "l_tax", "l_quantity")
    return ml.train_model(li, "l_returnflag", "Logistic Regression")


def _problem_types(spark, sf):
    return ml.problem_types(_li(spark, sf), ["l_extendedprice", "l_returnflag", "l_linenumber"])


def _split_sizes(spark, sf):
    li = _li(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    s = ml.split(li.withColumnRenamed("l_returnflag", "label"), 0.2, 42, stratify=True,
                 key=["l_orderkey", "l_linenumber"])
    return s.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


def _split_repeats(spark, sf):
    """Features that repeat: no key, a few distinct rows."""
    li = _li(spark, sf).select("l_linenumber", F.col("l_returnflag").alias("label"))
    return ml.split(li, 0.2, 42, stratify=True).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


def _split_plain(spark, sf):
    li = _li(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice")
    s = ml.split(li.withColumnRenamed("l_extendedprice", "label"), 0.2, 42, key=["l_orderkey", "l_linenumber"])
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


def _fold_sizes(spark, sf):
    li = _li(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"))
    f = ml.fold_column(li, 5, 42, stratify=True, key=["l_orderkey", "l_linenumber"])
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def _folds(spark, sf, by=None):
    li = _li(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"))
    # keys repeat in this table; rows equal in all three columns may change places
    return contiguous_folds(li, 5, ["l_orderkey", "l_linenumber", "label"], by)


def _predictions_sink(spark, sf):
    """A3: a linear model's test rows written by the sink under the session's checkpoint
    folder and scanned back."""
    p = table(spark, sf, "part").select("p_retailprice", "p_size", "p_partkey", (F.col("p_partkey") % 4 == 0).alias("t"))
    fit = ml.train_model(p, "p_retailprice", "Linear Regression", ["p_size", "p_partkey"], test_flag="t",
                         problem_type=ml.REGRESSION, order_by=["p_partkey"])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kiln-predictions-{uuid4().hex}"
    io.write_predictions(fit.predictions, ["p_size", "p_partkey"], path)
    return rounded(io.read_csv(spark, path), 4)


#: Coefficients (A, N, R) at which the gradient query stands; any would do.
AT_COEFFICIENTS, AT_INTERCEPTS, AT_REG = [[1.0, -2.0, 0.01], [0.5, 3.0, -0.02], [-1.5, 0.0, 0.03]], [0.2, 0.0, -0.1], 0.25


def _logistic_gradient(spark, sf):
    li = _li(spark, sf).select("l_discount", "l_tax", "l_quantity", F.when(F.col("l_returnflag") == "A", 0).when(
        F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))
    return rounded(certificate.logistic_gradient(li, ["l_discount", "l_tax", "l_quantity"], "label", AT_COEFFICIENTS,
                                                 AT_INTERCEPTS, AT_REG))


def _logistic_certificate(spark, sf):
    fit = _li_multiclass(spark, sf)
    out = certificate.logistic_certificate(fit.extra["train"], fit.model, fit.features)
    names = F.array(*[F.lit(str(v)) for v in fit.extra["labels"]])
    return out.select(names[F.col("class")].alias("class"), "feature", "within")


def _part_forest(spark, sf):
    p = table(spark, sf, "part").select("p_retailprice", "p_size", "p_partkey", (F.col("p_partkey") % 4 == 0).alias("t"))
    return ml.train_model(p, "p_retailprice", "Random Forest Regressor", ["p_size", "p_partkey"], test_flag="t",
                          problem_type=ml.REGRESSION, cv_folds=0, scale_features=False)


def _forest_walk(spark, sf):
    """Test rows of a forest and those whose prediction by joins over the node table is the model's."""
    fit = _part_forest(spark, sf)
    rows = fit.predictions.select("p_size", "p_partkey", F.col("prediction").alias("given"))
    walked = forest.predict_regression(rows, forest.node_table(fit.model), fit.features, forest.depth(fit.model),
                                       "p_partkey")
    return rows.join(walked, "p_partkey").select(
        "p_partkey", (F.abs(F.col("prediction") - F.col("given")) <= 1e-9 * F.abs("given")).alias("same"))


def _forest_importance(spark, sf):
    fit = _part_forest(spark, sf)
    again = forest.impurity_importance(forest.node_table(fit.model), fit.features, forest.VARIANCE)
    model = fit.importance.select("feature", F.col("importance").alias("given"))
    return again.join(model, "feature").select(
        "feature", (F.abs(F.col("importance") - F.col("given")) <= 1e-6).alias("same"))


def _forest_votes(spark, sf):
    """Test documents of a forest of classes, and those whose predicted class has the largest
    share by joins over the node table."""
    d = _docs(spark, sf, "doc_id").drop("quality").withColumn("t", F.col("doc_id") % 4 == 0)
    fit = ml.train_model(d, "toxic", "Random Forest Classifier", ["n_chars", "n_words", "n_digits", "n_lines"],
                         test_flag="t", problem_type=ml.CLASSIFICATION, cv_folds=0)
    rows = materialize(fit.predictions.select(*fit.features, "prediction").withColumn(
        "row", F.monotonically_increasing_id()))
    share = forest.votes(rows, forest.node_table(fit.model), fit.features, forest.depth(fit.model), "row")
    best = share.groupBy("row").agg(F.max("share").alias("top"))
    mine = rows.join(share, "row").filter(F.col("class") == F.col("prediction").cast("int")).join(best, "row")
    return mine.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") >= F.col("top") - 1e-9).alias("same"))


QUERIES = {
    "ml_rf_regression_walk": _forest_walk,
    "ml_rf_importance_from_nodes": _forest_importance,
    "ml_rf_classifier_votes": _forest_votes,
    "ml_folds_contiguous": _folds,
    "ml_folds_stratified": lambda s, d: _folds(s, d, "label"),
    "ml_linreg_cv_summary": lambda s, d: rounded(_linreg(s, d).cv_summary, 2),
    "ml_logistic_gradient": _logistic_gradient,
    "ml_logistic_certificate": _logistic_certificate,
    "io_predictions_sink": _predictions_sink,
    "ml_split_plain": _split_plain,
    "ml_split_repeats": _split_repeats,
    "ml_fold_sizes": _fold_sizes,
    "ml_problem_type": _problem_types,
    "ml_prepare_features": lambda s, d: rounded(ml.prepare_features(
        _li(s, d).select("l_quantity", "l_discount", "l_returnflag", "l_extendedprice"), "l_extendedprice")[0]),
    "ml_split_stratified": _split_sizes,
    "ml_metrics_regression": lambda s, d: rounded(M.regression_metrics(_fixed_reg(s, d), "y", "yhat")),
    "ml_metrics_classification": lambda s, d: rounded(M.classification_metrics(_fixed_bin(s, d), "cls", "pred")),
    "ml_confusion_matrix": lambda s, d: M.confusion_matrix(_fixed_bin(s, d), "cls", "pred"),
    "ml_classification_report": lambda s, d: rounded(M.classification_report(_fixed_bin(s, d), "cls", "pred")),
    "ml_roc_auc": lambda s, d: rounded(M.roc_auc(_fixed_bin(s, d), "y", "score")),
    "ml_roc_auc_ovr": lambda s, d: rounded(M.roc_auc_ovr(_fixed_bin(s, d), "cls",
                                                         {"A": "score", "N": "s_n", "R": "s_r"})),
    "ml_roc_curve": lambda s, d: rounded(M.roc_curve(_fixed_bin(s, d), "y", "score")),
    "ml_residuals": lambda s, d: rounded(M.residuals(_fixed_reg(s, d), "y", "yhat")[0]),
    "ml_residual_histogram": lambda s, d: rounded(M.residuals(_fixed_reg(s, d), "y", "yhat")[1]),
    "ml_actual_vs_predicted": lambda s, d: rounded(M.actual_vs_predicted(_fixed_reg(s, d), "y", "yhat")[1]),
    "ml_linreg_metrics": lambda s, d: rounded(_linreg(s, d).metrics),
    "ml_linreg_predictions": lambda s, d: rounded(_linreg(s, d).predictions.select(
        "l_quantity", "label", "prediction")),
    "ml_linreg_cv": lambda s, d: rounded(_linreg(s, d).cv_scores, 2),
    "ml_rf_regression_metrics": lambda s, d: _part_reg(s, d, "Random Forest Regressor").metrics,
    "ml_rf_regression_importance": lambda s, d: M.top_importance(
        _part_reg(s, d, "Random Forest Regressor").importance, 20),
    "ml_gbt_regression_metrics": lambda s, d: _part_reg(s, d, "XGBoost Regressor").metrics,
    "ml_logistic_metrics": lambda s, d: _doc_cls(s, d, "Logistic Regression").metrics,
    "ml_logistic_multiclass_importance": lambda s, d: _li_multiclass(s, d).importance,
    "ml_rf_classifier_metrics": lambda s, d: _doc_cls(s, d, "Random Forest Classifier", "toxic").metrics,
    "ml_gbt_classifier_metrics": lambda s, d: _doc_cls(s, d, "XGBoost").metrics,
    "ml_cv_summary": lambda s, d: _doc_cls(s, d, "Random Forest Classifier").cv_summary,
    "ml_predictions_sink_frame": lambda s, d: io.predictions_frame(
        _part_reg(s, d, "Linear Regression").predictions, ["p_size", "p_partkey"]),
}

_BIN = """b as (select (l_returnflag = 'R')::integer as y, l_discount as score, l_returnflag as cls,
  case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end as pred,
  l_tax as s_n, l_quantity / 50 as s_r from lineitem)"""
_CM = f"""{_BIN},
labs as (select distinct v from (select cls as v from b union all select pred from b) where v is not null),
cnt as (select cls as actual, pred as predicted, count(*) as c from b group by 1, 2),
cm as (select a.v as actual, p.v as predicted, coalesce(c, 0) as count from labs a cross join labs p
       left join cnt on cnt.actual = a.v and cnt.predicted = p.v),
per as (select actual as class, sum(case when actual = predicted then count end) as tp, sum(count) as support
        from cm group by actual),
pt as (select predicted as class, sum(count) as pred from cm group by predicted),
pr as (select per.class, tp, support, coalesce(tp::double / nullif(pred, 0), 0) as precision,
              coalesce(tp::double / nullif(support, 0), 0) as recall from per join pt using (class)),
pf as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from pr),
rep as (select class, precision, recall, f1, support::double as support from pf
  union all select 'accuracy', sum(tp)::double / sum(support), sum(tp)::double / sum(support),
                   sum(tp)::double / sum(support), sum(support)::double from pf
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::double from pf
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support)::double from pf)"""


def _auc_sql(pos_expr, score, src="b", part=""):
    return f"""select (sum(case when {pos_expr} then rk end) - np * (np + 1) / 2.0) / (np * nn) as auc
from (select *, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as rk,
             count_if({pos_expr}) over () as np, count_if(not ({pos_expr})) over () as nn
      from {src} where {score} is not null) group by np, nn"""


SQL = {
    "ml_problem_type": """select 'l_extendedprice' as target,
  case when count(distinct l_extendedprice) > 10 then 'regression' else 'classification' end as problem_type from lineitem
union all select 'l_returnflag', case when typeof(any_value(l_returnflag)) = 'VARCHAR' then 'classification'
  else 'regression' end from lineitem
union all select 'l_linenumber', case when count(distinct l_linenumber) > 10 then 'regression'
  else 'classification' end from lineitem""",
    "ml_prepare_features": f"""select {r('l_quantity')} as l_quantity, {r('l_discount')} as l_discount,
  {r('l_extendedprice')} as label from lineitem
where l_quantity is not null and l_discount is not null and l_extendedprice is not null""",
    "ml_split_stratified": """select l_returnflag as label, true as is_test, ceil(0.2 * count(*))::bigint as n
from lineitem group by l_returnflag
union all select l_returnflag, false, count(*) - ceil(0.2 * count(*))::bigint from lineitem group by l_returnflag""",
    "ml_split_plain": """select true as is_test, ceil(0.2 * count(*))::bigint as n from lineitem
union all select false, count(*) - ceil(0.2 * count(*))::bigint from lineitem""",
    "ml_fold_sizes": """select label, fold, count(*) as n from (
  select l_returnflag as label, ((row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) - 1) % 5)::integer as fold
  from lineitem) group by label, fold""",
    "ml_metrics_regression": f"""with d as (select l_extendedprice as y, l_quantity * 1000 as yhat from lineitem)
select 'RMSE' as metric, {r('sqrt(avg((y - yhat) * (y - yhat)))')} as value from d
union all select 'MAE', {r('avg(abs(y - yhat))')} from d
union all select 'R2', {r('1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))')} from d""",
    "ml_confusion_matrix": f"with {_CM}\nselect actual, predicted, count from cm",
    "ml_classification_report": f"""with {_CM}
select class, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, {r('support')} as support
from rep""",
    "ml_metrics_classification": f"""with {_CM}
select case when class = 'accuracy' then 'Accuracy' else 'F1 (weighted)' end as metric,
       {r("case when class = 'accuracy' then precision else f1 end")} as value
from rep where class in ('accuracy', 'weighted avg')""",
    "ml_roc_auc": f"with {_BIN}\nselect {r('auc')} as auc from ({_auc_sql('y = 1', 'score')})",
    "ml_roc_auc_ovr": f"""with {_BIN},
l as (select cls as y, 'A' as c, score as s from b union all select cls, 'N', s_n from b
      union all select cls, 'R', s_r from b),
a as (select c, (sum(case when y = c then rk end) - np * (np + 1) / 2.0) / (np * nn) as auc, np
      from (select *, rank() over (partition by c order by s) + (count(*) over (partition by c, s) - 1) / 2.0 as rk,
                   count_if(y = c) over (partition by c) as np, count_if(not (y = c)) over (partition by c) as nn
            from l where s is not null) group by c, np, nn)
select {r('sum(auc * np) / sum(np)')} as auc from a""",
    "ml_roc_curve": f"""with {_BIN},
g as (select score as s, sum(y) as tp, sum(1 - y) as fp from b where score is not null group by score),
t as (select sum(y) as P, sum(1 - y) as N from b where score is not null)
select 'inf'::double as threshold, 0.0::double as fpr, 0.0::double as tpr
union all
select {r('s')}, {r('sum(fp) over (order by s desc) / N')}, {r('sum(tp) over (order by s desc) / P')}
from g cross join t""",
    "ml_residuals": f"""select {r('l_quantity * 1000.0')} as fitted, {r('l_extendedprice - l_quantity * 1000')} as residual
from lineitem""",
    "ml_actual_vs_predicted": f"""with d as (select l_extendedprice as y, l_quantity * 1000 as p from lineitem)
select {r('least(min(y), min(p))')} as lo, {r('greatest(max(y), max(p))')} as hi,
       {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} as r2 from d""",
}

_OLS = """ols as (select regr_slope(l_extendedprice, l_quantity) as b1, regr_intercept(l_extendedprice, l_quantity) as b0
        from lineitem where l_orderkey % 5 <> 0),
te as (select l_quantity, l_extendedprice as label, b0 + b1 * l_quantity as prediction
       from lineitem cross join ols where l_orderkey % 5 = 0)"""
SQL["ml_linreg_predictions"] = f"""with {_OLS}
select {r('l_quantity')} as l_quantity, {r('label')} as label, {r('prediction')} as prediction from te"""
SQL["ml_linreg_metrics"] = f"""with {_OLS}
select 'RMSE' as metric, {r('sqrt(avg((label - prediction) * (label - prediction)))')} as value from te
union all select 'MAE', {r('avg(abs(label - prediction))')} from te
union all select 'R2', {r('1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))')} from te"""
SQL["ml_residual_histogram"] = f"""with d as (select l_extendedprice - l_quantity * 1000 as v from lineitem),
rg as (select case when min(v) = max(v) then min(v) - 0.5 else min(v) end as lo,
              case when min(v) = max(v) then max(v) + 0.5 else max(v) end as hi from d),
c as (select least(floor((v - lo) * 30 / (hi - lo))::integer, 29) as bin, count(*) as n from d cross join rg group by 1),
g as (select unnest(range(0, 30)) as bin)
select g.bin::integer as bin, {r('lo + g.bin * (hi - lo) / 30.0')} as lower, {r('lo + (g.bin + 1) * (hi - lo) / 30.0')} as upper,
       coalesce(n, 0) as count from g cross join rg left join c using (bin)"""
SQL["ml_split_repeats"] = SQL["ml_split_stratified"]

_FOLDS = """f as (select *, ntile(5) over (order by l_orderkey, l_linenumber, l_extendedprice, l_quantity) as fold
      from lineitem where l_orderkey % 5 <> 0),
fit as (select k as fold, regr_slope(l_extendedprice, l_quantity) as b1, regr_intercept(l_extendedprice, l_quantity) as b0
        from f, range(1, 6) g(k) where f.fold <> k group by k),
cv as (select fold::integer as fold, -avg((l_extendedprice - b0 - b1 * l_quantity) * (l_extendedprice - b0 - b1 * l_quantity)) as score
       from f join fit using (fold) group by fold)"""
SQL["ml_linreg_cv"] = f"with {_FOLDS}\nselect fold, {r('score', 2)} as score from cv"
SQL["ml_linreg_cv_summary"] = f"""with {_FOLDS}
select {r('avg(score)', 2)} as cv_mean, {r('stddev_pop(score)', 2)} as cv_std from cv"""
SQL["ml_folds_contiguous"] = """select l_orderkey, l_linenumber, l_returnflag as label,
  (ntile(5) over (order by l_orderkey, l_linenumber, l_returnflag) - 1)::integer as fold from lineitem"""
SQL["ml_folds_stratified"] = """with t as (
  select l_orderkey, l_linenumber, l_returnflag as label, row_number() over (order by l_orderkey, l_linenumber, l_returnflag) as g,
         row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) as j from lineitem),
first as (select label, min(g) as g0 from t group by label),
place as (select label, row_number() over (order by g0, g) - 1 as p from t join first using (label)),
share as (select label, k, (select count(*) from place x where x.label = first.label and x.p % 5 = k) as n
          from first, range(0, 5) h(k)),
upto as (select label, k, sum(n) over (partition by label order by k) as last from share)
select l_orderkey, l_linenumber, label, min(k)::integer as fold
from t join upto using (label) where j <= last group by l_orderkey, l_linenumber, label, g"""
_W = {c: (w, b) for c, w, b in zip("ANR", AT_COEFFICIENTS, AT_INTERCEPTS)}
_X = ["l_discount", "l_tax", "l_quantity"]
_EXP = {c: "exp(" + " + ".join(f"({v}) * {x}" for v, x in zip(w, _X)) + f" + ({b}))" for c, (w, b) in _W.items()}
_PENALTY = AT_REG / 2 * sum(v * v for w in AT_COEFFICIENTS for v in w)
SQL["ml_logistic_gradient"] = f"""with e as (select l_discount, l_tax, l_quantity, 1.0::double as one, l_returnflag as y,
  {", ".join(f"{e} as e{c}" for c, e in _EXP.items())} from lineitem),
p as (select *, eA + eN + eR as z, case y when 'A' then eA when 'N' then eN else eR end as own from e)
""" + "\nunion all\n".join(
    f"""select {k} as class, '{name}' as feature, {r(f"avg((e{c} / z - (y = '{c}')::integer) * {x}) + ({AT_REG * w})")} as gradient,
  {r(f'sqrt(avg({x} * {x}))')} as scale, {r(f'avg(-ln(own / z)) + {_PENALTY}')} as loss from p"""
    for k, c in enumerate("ANR") for x, name, w in zip([*_X, "one"], [*_X, certificate.INTERCEPT], [*_W[c][0], 0.0]))
SQL["ml_logistic_certificate"] = """select class, feature, true as within
from (select distinct l_returnflag as class from lineitem),
     (select unnest(['l_discount', 'l_tax', 'l_quantity', '(intercept)']) as feature)"""
SQL["io_predictions_sink"] = f"""with s as (select var_pop(p_size) as xx, var_pop(p_partkey) as zz, covar_pop(p_size, p_partkey) as xz,
  covar_pop(p_size, p_retailprice) as xy, covar_pop(p_partkey, p_retailprice) as zy, avg(p_size) as mx, avg(p_partkey) as mz,
  avg(p_retailprice) as my from part where p_partkey % 4 <> 0),
b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) as b2 from s)
select p_size::double as p_size, p_partkey::double as p_partkey, {r('p_retailprice', 4)} as y_actual,
  {r('my + b1 * (p_size - mx) + b2 * (p_partkey - mz)', 4)} as y_predicted from part, b where p_partkey % 4 = 0"""
SQL["ml_rf_regression_walk"] = """select p_partkey::double as p_partkey, true as same from part
where p_partkey % 4 = 0 and p_size is not null and p_retailprice is not null"""
SQL["ml_rf_importance_from_nodes"] = """select unnest(['p_size', 'p_partkey']) as feature, true as same"""
SQL["ml_rf_classifier_votes"] = """select count(*) as n, count(*) as same from documents join labels using (doc_id)
where doc_id % 4 = 0 and text is not null and n_chars is not null and toxic is not null"""
