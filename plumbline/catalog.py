"""Queries over the driver tables, each with DuckDB SQL that gives the same rows.

Predictions are derived from `orders` with noise from md5, alike in every engine: two scored models A and B, and
three rules R1-R3 that flip the label of some rows; datasets are the order priorities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType

from plumbline.functions import storage
from plumbline.functions.rounding import rounded
from plumbline.operators import clean, errors, folds, intervals, metrics, paired, profile, replicates, rules, shift, transfer
from plumbline.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _u(salt: str, column: str = "o_orderkey") -> F.Column:
    h = F.md5(F.concat(F.lit(f"{salt}:"), F.col(column).cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 10000) / F.lit(10000.0)


def _u_sql(salt: str, column: str = "o_orderkey") -> str:
    return f"(('0x' || substr(md5('{salt}:' || {column}), 1, 8))::BIGINT % 10000) / 1e4"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("kind"), (F.col("o_totalprice") > 200000).cast("int").alias("y_true"), *[_u(s).alias(f"u{s}") for s in "abmds"])
    y = F.col("y_true")
    flip = lambda s, p: F.when(F.col(f"u{s}") < p, 1 - y).otherwise(y)
    o = o.select("sample_id", "dataset", "kind", "y_true", (F.lit(0.35) * y + F.lit(0.65) * F.col("ua")).alias("pa"), (F.lit(0.25) * y + F.lit(0.75) * F.col("ub")).alias("pb"), flip("m", 0.1).alias("R1"), flip("d", 0.15).alias("R2"), flip("s", 0.2).alias("R3"))
    return o


def folded_base(spark: SparkSession, d: str) -> DataFrame:
    return folds.stratified(base(spark, d), 10, "y_true", "sample_id")


BASE = f"""base AS (SELECT *, ((row_number() OVER (PARTITION BY y_true ORDER BY md5('42:' || sample_id), sample_id) - 1) % 10)::INT AS fold FROM (
  SELECT sample_id, dataset, kind, y_true, 35e-2 * y_true + 65e-2 * ua AS pa, 25e-2 * y_true + 75e-2 * ub AS pb,
    CASE WHEN um < 1e-1 THEN 1 - y_true ELSE y_true END AS R1, CASE WHEN ud < 15e-2 THEN 1 - y_true ELSE y_true END AS R2, CASE WHEN us < 2e-1 THEN 1 - y_true ELSE y_true END AS R3 FROM (
    SELECT o_orderkey AS sample_id, o_orderpriority AS dataset, o_orderstatus AS kind, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS y_true, {", ".join(f"{_u_sql(s)} AS u{s}" for s in "abmds")} FROM orders)))"""


def folded(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, folded_base)


def predictions(spark: SparkSession, d: str, rows: Query = base) -> DataFrame:
    none = F.lit(None).cast("double")
    e = [("A", "model", F.col("pa"), 0.45), ("B", "model", F.col("pb"), 0.35)]
    each = [F.struct(F.lit(n).alias("entity"), F.lit(t).alias("entity_type"), p.alias("y_prob"), F.lit(c).alias("threshold"), (p >= c).cast("int").alias("y_pred")) for n, t, p, c in e]
    each += [F.struct(F.lit(n).alias("entity"), F.lit("rule").alias("entity_type"), none.alias("y_prob"), none.alias("threshold"), F.col(n).alias("y_pred")) for n in ("R1", "R2", "R3")]
    o = rows(spark, d)
    keys = [c for c in ("dataset", "kind", "fold", "sample_id", "y_true") if c in o.columns]
    return o.select(*keys, F.explode(F.array(*each)).alias("e")).select(*keys, "e.*")


PRED = BASE + """, pred AS (
  SELECT dataset, kind, fold, sample_id, y_true, 'A' AS entity, 'model' AS entity_type, pa AS y_prob, 45e-2 AS threshold, (pa >= 45e-2)::INT AS y_pred FROM base
  UNION ALL SELECT dataset, kind, fold, sample_id, y_true, 'B', 'model', pb, 35e-2, (pb >= 35e-2)::INT FROM base
  UNION ALL SELECT dataset, kind, fold, sample_id, y_true, 'R1', 'rule', NULL, NULL, R1 FROM base
  UNION ALL SELECT dataset, kind, fold, sample_id, y_true, 'R2', 'rule', NULL, NULL, R2 FROM base
  UNION ALL SELECT dataset, kind, fold, sample_id, y_true, 'R3', 'rule', NULL, NULL, R3 FROM base)"""


def _counts(keys: str, rows: str = "pred", p: str = "y_pred") -> str:
    return f"SELECT {keys}, count(*) FILTER (y_true = 1 AND {p} = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND {p} = 1)::DOUBLE AS fp, count(*) FILTER (y_true = 0 AND {p} = 0)::DOUBLE AS tn, count(*) FILTER (y_true = 1 AND {p} = 0)::DOUBLE AS fn FROM {rows} GROUP BY ALL"


_R = lambda a, b: f"coalesce(({a}) / nullif({b}, 0e0), 0e0)"
METRICS = {
    "precision_0": _R("tn", "tn + fn"), "precision_1": _R("tp", "tp + fp"), "recall_0": _R("tn", "tn + fp"), "recall_1": _R("tp", "tp + fn"), "f1_0": _R("2e0 * tn", "2e0 * tn + fn + fp"), "f1_1": _R("2e0 * tp", "2e0 * tp + fp + fn"),
    "f1_weighted": _R(f"(tn + fp) * {_R('2e0 * tn', '2e0 * tn + fn + fp')} + (tp + fn) * {_R('2e0 * tp', '2e0 * tp + fp + fn')}", "tp + fp + tn + fn"),
    "mcc": _R("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"),
    "balanced_accuracy": f"CASE WHEN tp + fn = 0 THEN {_R('tn', 'tn + fp')} WHEN tn + fp = 0 THEN {_R('tp', 'tp + fn')} ELSE ({_R('tn', 'tn + fp')} + {_R('tp', 'tp + fn')}) / 2e0 END",
}
ALL = ", ".join(f"{e} AS {n}" for n, e in METRICS.items())
NAMES = " ".join(METRICS)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles at six decimals (halves as the SQL rounds them), whole numbers as long."""
    return df.select(*[rounded(f.name, 6).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, IntegralType) else F.col(f.name) for f in df.schema])


def _register(name: str, sql: str | None, keys: str = "", ints: str = "", doubles: str = "") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = lambda spark, d: tidy(f(spark, d))
        if sql is not None:
            columns = keys.split() + [f"{c}::BIGINT AS {c}" for c in ints.split()] + [f"round({c}, 6) AS {c}" for c in doubles.split()]
            _SQL[name] = f"SELECT {', '.join(columns)} FROM ({sql})"
        return f

    return put


def _p(sql: str) -> str:
    return f"WITH {PRED} {sql}"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# metrics
_register("confusion_counts", _p(_counts("entity")), "entity", "tp fp tn fn")(lambda s, d: metrics.confusion(predictions(s, d), ["entity"]))
_register("precision_recall_f1", _p(f"SELECT entity, {ALL} FROM ({_counts('entity')})"), "entity", doubles=NAMES)(lambda s, d: metrics.confusion(predictions(s, d), ["entity"]).select("entity", *[c.alias(n) for n, c in metrics.scores().items()]))
for _m in ("mcc", "balanced_accuracy"):
    _register(f"{_m}_by_entity", _p(f"SELECT entity, dataset, {METRICS[_m]} AS {_m} FROM ({_counts('entity, dataset')})"), "entity dataset", doubles=_m)(
        lambda s, d, m=_m: metrics.confusion(predictions(s, d), ["entity", "dataset"]).select("entity", "dataset", metrics.scores()[m].alias(m))
    )
MID = "mid AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {k}, y_prob) - 1) / 2e0 AS r FROM pred WHERE y_prob IS NOT NULL WINDOW w AS (PARTITION BY {k} ORDER BY y_prob))"
AUC = "SELECT {k}, (sum(CASE WHEN y_true = 1 THEN r ELSE 0e0 END) - sum(y_true) * (sum(y_true) + 1) / 2e0) / nullif(sum(y_true) * (count(*) - sum(y_true)), 0) AS auroc FROM mid GROUP BY ALL"
_register("auroc_midrank", _p(f", {MID.format(k='entity')} {AUC.format(k='entity')}"), "entity", doubles="auroc")(lambda s, d: metrics.auroc(predictions(s, d), ["entity"]))
_register("auroc_by_fold", _p(f", {MID.format(k='entity, dataset, fold')} {AUC.format(k='entity, dataset, fold')}"), "entity dataset", "fold", "auroc")(lambda s, d: metrics.auroc(folded(s, d), ["entity", "dataset", "fold"]))
_register("brier", _p("SELECT entity, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM pred WHERE y_prob IS NOT NULL GROUP BY entity"), "entity", doubles="brier")(lambda s, d: metrics.brier(predictions(s, d), ["entity"]))
BIN = "CASE " + " ".join(f"WHEN y_prob <= {e:.17e} THEN {i}" for i, e in enumerate(metrics.EDGES[1:])) + " END"
BINS = f"bins AS (SELECT entity, {BIN} AS bin, count(*) AS n, avg(y_prob) AS mean_prob, avg(y_true) AS positive_rate FROM pred WHERE y_prob BETWEEN 0e0 AND 1e0 GROUP BY ALL)"
_register("reliability_bins", _p(f", {BINS} SELECT * FROM bins"), "entity", "bin n", "mean_prob positive_rate")(lambda s, d: metrics.reliability(predictions(s, d), ["entity"]))
_register("ece_mce", _p(f", {BINS} SELECT entity, sum(n * abs(positive_rate - mean_prob)) / sum(n) AS ece, max(abs(positive_rate - mean_prob)) AS mce FROM bins GROUP BY entity"), "entity", doubles="ece mce")(lambda s, d: metrics.calibration_error(predictions(s, d), ["entity"]))
_register("confusion_normalized", _p("SELECT entity, y_true, y_pred, count(*) / sum(count(*)) OVER (PARTITION BY entity, y_true) AS share FROM pred GROUP BY entity, y_true, y_pred"), "entity", "y_true y_pred", "share")(lambda s, d: metrics.confusion_normalized(predictions(s, d), ["entity"]))
_register("confusion_normalized_mean", _p("SELECT entity, y_true, y_pred, avg(share) AS share FROM (SELECT entity, fold, y_true, y_pred, count(*) / sum(count(*)) OVER (PARTITION BY entity, fold, y_true) AS share FROM pred GROUP BY entity, fold, y_true, y_pred) GROUP BY ALL"), "entity", "y_true y_pred", "share")(
    lambda s, d: metrics.confusion_normalized(folded(s, d), ["entity", "fold"]).groupBy("entity", "y_true", "y_pred").agg(F.avg("share").alias("share"))
)


def _curve_sql(k: str) -> str:
    return f"""points AS (SELECT {k}, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM pred WHERE y_prob IS NOT NULL GROUP BY ALL),
 sums AS (SELECT {k}, y_prob, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {k}) AS n1, sum(neg) OVER (PARTITION BY {k}) AS n0 FROM points WINDOW w AS (PARTITION BY {k} ORDER BY y_prob DESC)),
 curve AS (SELECT {k}, y_prob, tp, fp, coalesce(fp / nullif(n0, 0), 0e0) AS fpr, coalesce(tp / nullif(n1, 0), 0e0) AS tpr, coalesce(tp / nullif(tp + fp, 0), 0e0) AS prec FROM sums)"""


_register("roc_curve", _p(f", {_curve_sql('entity')} SELECT * FROM curve"), "entity", "tp fp", "y_prob fpr tpr")(lambda s, d: metrics.curve(predictions(s, d), ["entity"]).drop("prec"))
_register("pr_curve", _p(f", {_curve_sql('entity')} SELECT * FROM curve"), "entity", "tp fp", "y_prob tpr prec")(lambda s, d: metrics.curve(predictions(s, d), ["entity"]).drop("fpr"))
_register("operating_points", _p(f"SELECT entity, {_R('fp', 'fp + tn')} AS fpr, {METRICS['recall_1']} AS tpr, {METRICS['precision_1']} AS prec FROM ({_counts('entity')})"), "entity", doubles="fpr tpr prec")(
    lambda s, d: metrics.confusion(predictions(s, d), ["entity"]).select("entity", metrics.ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), metrics.scores()["recall_1"].alias("tpr"), metrics.scores()["precision_1"].alias("prec"))
)
FOLD = f"wide AS (SELECT entity, fold, {ALL} FROM ({_counts('entity, fold')})), long AS (UNPIVOT wide ON {', '.join(METRICS)} INTO NAME metric VALUE value)"


def fold_metrics(s: SparkSession, d: str) -> DataFrame:
    wide = metrics.confusion(folded(s, d), ["entity", "fold"]).select("entity", "fold", *[c.alias(n) for n, c in metrics.scores().items()])
    return metrics.long(wide, ["entity", "fold"], list(METRICS))


_register("fold_metric_summary", _p(f", {FOLD} SELECT entity, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS median FROM long GROUP BY ALL"), "entity metric", doubles="mean std least most median")(lambda s, d: metrics.summary(fold_metrics(s, d)))
_register("summary_text", _p(f", {FOLD}, t AS (SELECT entity, metric, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY ALL) SELECT entity, metric, printf('%.3f', m) || ' ± ' || printf('%.3f', s) AS text FROM t"), "entity metric text")(lambda s, d: metrics.summary_text(metrics.summary(fold_metrics(s, d))))
_register("metrics_wide", _p(f", {FOLD} SELECT entity, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std' for m in ('mcc', 'f1_1'))} FROM wide GROUP BY entity"), "entity", doubles="mcc_mean mcc_std f1_1_mean f1_1_std")(
    lambda s, d: fold_metrics(s, d).where(F.col("metric").isin("mcc", "f1_1")).groupBy("entity").pivot("metric", ["mcc", "f1_1"]).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
)
_register("metrics_default_vs_opt", _p(f"SELECT a.entity, a.mcc AS at_half, b.mcc AS at_own FROM (SELECT entity, {METRICS['mcc']} AS mcc FROM ({_counts('entity', '(SELECT * FROM pred WHERE y_prob IS NOT NULL)', '(y_prob >= 5e-1)::INT')})) a JOIN (SELECT entity, {METRICS['mcc']} AS mcc FROM ({_counts('entity')})) b USING (entity)"), "entity", doubles="at_half at_own")(
    lambda s, d: metrics.confusion(predictions(s, d).where("y_prob is not null"), ["entity"], (F.col("y_prob") >= 0.5).cast("int")).select("entity", metrics.scores()["mcc"].alias("at_half")).join(metrics.confusion(predictions(s, d), ["entity"]).select("entity", metrics.scores()["mcc"].alias("at_own")), "entity")
)


# thresholds
def _youden_sql(k: str) -> str:
    return f"{_curve_sql(k)}, youden AS (SELECT {k}, y_prob AS threshold, tpr - fpr AS j, tpr AS sens, 1e0 - fpr AS spec FROM curve QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY round(tpr - fpr, 12) DESC, y_prob DESC) = 1)"


_register("youden_oof", _p(f", {_youden_sql('entity')} SELECT * FROM youden"), "entity", doubles="threshold j sens spec")(lambda s, d: metrics.youden(predictions(s, d), ["entity"]))
_register("youden_by_fold", _p(f", {_youden_sql('entity, fold')} SELECT * FROM youden"), "entity", "fold", "threshold j sens spec")(lambda s, d: metrics.youden(folded(s, d), ["entity", "fold"]))
_register("metrics_at_threshold", _p(f"SELECT entity, {METRICS['recall_1']} AS sens, {METRICS['recall_0']} AS spec, {METRICS['recall_1']} + {METRICS['recall_0']} - 1 AS j FROM ({_counts('entity', '(SELECT * FROM pred WHERE y_prob IS NOT NULL)', '(y_prob >= 6e-1)::INT')})"), "entity", doubles="sens spec j")(
    lambda s, d: metrics.at_threshold(predictions(s, d), ["entity"], F.lit(0.6))
)
_register("threshold_summary", _p(f", {_youden_sql('entity, fold')} SELECT entity, round(avg(threshold), 12) AS mean, stddev_pop(threshold) AS std, round(avg(j), 12) AS j, round(avg(sens), 12) AS sens, round(avg(spec), 12) AS spec FROM youden GROUP BY entity"), "entity", doubles="mean std j sens spec")(
    lambda s, d: metrics.youden(folded(s, d), ["entity", "fold"]).groupBy("entity").agg(metrics.fold_mean("threshold").alias("mean"), F.stddev_pop("threshold").alias("std"), metrics.fold_mean("j").alias("j"), metrics.fold_mean("sens").alias("sens"), metrics.fold_mean("spec").alias("spec"))
)
_register("threshold_from_folds", _p(f", {_youden_sql('entity, fold')}, t AS (SELECT entity, round(avg(threshold), 12) AS threshold FROM youden GROUP BY entity) SELECT entity, threshold, {METRICS['recall_1']} AS sens, {METRICS['recall_0']} AS spec FROM ({_counts('entity, threshold', '(SELECT p.* EXCLUDE threshold, t.threshold FROM pred p JOIN t USING (entity))', '(y_prob >= threshold)::INT')})"), "entity", doubles="threshold sens spec")(
    lambda s, d: metrics.confusion(folded(s, d).drop("threshold").join(F.broadcast(metrics.cv_threshold(folded(s, d))), "entity"), ["entity", "threshold"], (F.col("y_prob") >= F.col("threshold")).cast("int")).select("entity", "threshold", metrics.scores()["recall_1"].alias("sens"), metrics.scores()["recall_0"].alias("spec"))
)
_register("apply_threshold", _p("SELECT entity, fold, sum(CASE WHEN y_prob >= coalesce(threshold, 5e-1) THEN 1 ELSE 0 END) AS n_called, count(*) AS n FROM pred WHERE y_prob IS NOT NULL GROUP BY ALL"), "entity", "fold n_called n")(
    lambda s, d: folded(s, d).where("y_prob is not null").groupBy("entity", "fold").agg(F.sum((F.col("y_prob") >= F.coalesce("threshold", F.lit(0.5))).cast("int")).alias("n_called"), F.count("*").alias("n"))
)

# rules
RULES = ["R1", "R2", "R3"]


def _rules_sql(exprs: list[str]) -> str:
    one = [f"SELECT sample_id, dataset, fold, y_true, '{e}' AS entity, ({' '.join(f'{t} = 1' if t in RULES else t for t in e.split())})::INT AS y_pred FROM base" for e in exprs]
    return f"called AS ({' UNION ALL '.join(one)})"


def _rule_query(name: str, exprs: list[str]) -> None:
    _register(name, f"WITH {BASE}, {_rules_sql(exprs)} SELECT entity, fold, {ALL} FROM ({_counts('entity, fold', 'called')})", "entity", "fold", NAMES)(
        lambda s, d: metrics.confusion(rules.predictions(folded_base(s, d), [e for e in exprs if e in RULES], [e for e in exprs if e not in RULES], ["dataset", "fold", "y_true"]), ["entity", "fold"]).select("entity", "fold", *[c.alias(n) for n, c in metrics.scores().items()])
    )


_rule_query("caller_single", RULES)
_rule_query("caller_and", [e for e in rules.defaults(RULES) if "AND" in e])
_rule_query("caller_or", [e for e in rules.defaults(RULES) if "OR" in e])
_rule_query("caller_default_combos", rules.defaults(RULES))
_register("caller_baseline_pivot", f"WITH {BASE}, {_rules_sql(RULES + rules.defaults(RULES))}, m AS (SELECT entity, dataset, {METRICS['mcc']} AS mcc FROM ({_counts('entity, dataset', 'called')})) SELECT entity, max(mcc) FILTER (dataset = '1-URGENT') AS urgent, max(mcc) FILTER (dataset = '5-LOW') AS low FROM m GROUP BY entity", "entity", doubles="urgent low")(
    lambda s, d: metrics.confusion(rules.predictions(base(s, d), RULES, rules.defaults(RULES), ["dataset", "y_true"]), ["entity", "dataset"]).select("entity", "dataset", metrics.scores()["mcc"].alias("mcc")).groupBy("entity").pivot("dataset", ["1-URGENT", "5-LOW"]).agg(F.max("mcc")).toDF("entity", "urgent", "low")
)
_register("filter_any", f"WITH {BASE} SELECT dataset, count(*) AS n FROM base WHERE R1 = 1 OR R2 = 1 GROUP BY dataset", "dataset", "n")(lambda s, d: rules.where_any(base(s, d), ["R1", "R2", "nope"]).groupBy("dataset").agg(F.count("*").alias("n")))
_register("filter_all", f"WITH {BASE} SELECT dataset, count(*) AS n FROM base WHERE R1 = 1 AND R2 = 1 GROUP BY dataset", "dataset", "n")(lambda s, d: rules.where_any(base(s, d), ["R1", "R2"], every=True).groupBy("dataset").agg(F.count("*").alias("n")))
_register("caller_validation", f"WITH {BASE} SELECT unnest(['R1', 'R2', 'sample_id']) AS name, unnest([count(*) FILTER (R1 NOT IN (0, 1)), count(*) FILTER (R2 NOT IN (0, 1)), count(*) FILTER (sample_id NOT IN (0, 1))]) AS bad FROM base", "name", "bad")(lambda s, d: rules.validate(base(s, d), ["R1", "R2", "sample_id"], "y_true"))


# paired tests; entity B lacks some samples, C has other labels
def unaligned(s: SparkSession, d: str) -> DataFrame:
    p = predictions(s, d).where("entity != 'B' or sample_id % 7 != 0")
    bad = p.where("entity = 'R3'").withColumn("entity", F.lit("R9")).withColumn("y_true", F.when(F.col("sample_id") % 11 == 0, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    return p.unionByName(bad)


_register("align_entities", _p(", u AS (SELECT * FROM pred WHERE entity <> 'B' OR sample_id % 7 <> 0) SELECT entity, count(*) AS n, sum(y_true) AS n_pos FROM u WHERE sample_id IN (SELECT sample_id FROM u WHERE entity = 'B') GROUP BY entity"), "entity", "n n_pos")(lambda s, d: paired.align(unaligned(s, d)).groupBy("entity").agg(F.count("*").alias("n"), F.sum("y_true").alias("n_pos")))
PAIRS = "pairs AS (SELECT a.entity AS name_a, b.entity AS name_b, count(*) AS n, count(*) FILTER (a.y_pred = a.y_true AND b.y_pred <> b.y_true) AS b_count, count(*) FILTER (a.y_pred <> a.y_true AND b.y_pred = b.y_true) AS c_count FROM pred a JOIN pred b ON a.sample_id = b.sample_id AND a.entity < b.entity GROUP BY ALL)"
_register("mcnemar_counts", _p(f", {PAIRS} SELECT * FROM pairs"), "name_a name_b", "n b_count c_count")(lambda s, d: paired.pairs(predictions(s, d)))
_register("mcnemar_stat", _p(f", {PAIRS} SELECT name_a, name_b, CASE WHEN b_count + c_count < 25 THEN b_count::DOUBLE ELSE (abs(b_count - c_count) - 1e0) * (abs(b_count - c_count) - 1e0) / (b_count + c_count) END AS statistic FROM pairs"), "name_a name_b", doubles="statistic")(
    lambda s, d: paired.mcnemar_statistic(paired.pairs(predictions(s, d))).select("name_a", "name_b", "statistic")
)
Z = "195996398454005e-14"
_register("effect_sizes", _p(f", {PAIRS}, e AS (SELECT *, (b_count - c_count) / n::DOUBLE AS acc_diff, sqrt(b_count + c_count - (b_count - c_count)::DOUBLE * (b_count - c_count) / n) / n AS se, b_count / c_count::DOUBLE AS odds, sqrt(1e0 / b_count + 1e0 / c_count) AS sl FROM pairs) SELECT name_a, name_b, acc_diff, acc_diff - {Z} * se AS acc_lo, acc_diff + {Z} * se AS acc_hi, odds, odds * exp(-{Z} * sl) AS odds_lo, odds * exp({Z} * sl) AS odds_hi FROM e"), "name_a name_b", doubles="acc_diff acc_lo acc_hi odds odds_lo odds_hi")(
    lambda s, d: paired.effects(paired.pairs(predictions(s, d))).drop("n", "b_count", "c_count")
)
_register("delong", _p(""", ranks AS (SELECT entity, sample_id, y_true, rank() OVER (PARTITION BY entity ORDER BY y_prob) + (count(*) OVER (PARTITION BY entity, y_prob) - 1) / 2e0 AS ra,
  rank() OVER (PARTITION BY entity, y_true ORDER BY y_prob) + (count(*) OVER (PARTITION BY entity, y_true, y_prob) - 1) / 2e0 AS rc, sum(y_true) OVER (PARTITION BY entity) AS n1, sum(1 - y_true) OVER (PARTITION BY entity) AS n0 FROM pred WHERE y_prob IS NOT NULL),
 v AS (SELECT *, CASE WHEN y_true = 1 THEN (ra - rc) / n0 ELSE 1e0 - (ra - rc) / n1 END AS v FROM ranks),
 w AS (SELECT a.y_true, a.v AS va, b.v AS vb FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.entity = 'A' AND b.entity = 'B'),
 s AS (SELECT y_true, count(*) AS n, avg(va) AS ma, avg(vb) AS mb, var_samp(va) + var_samp(vb) - 2e0 * covar_samp(va, vb) AS s FROM w GROUP BY y_true),
 t AS (SELECT max(ma) FILTER (y_true = 1) AS auroc_a, max(mb) FILTER (y_true = 1) AS auroc_b, sum(s / n) AS variance FROM s) SELECT *, auroc_a - auroc_b AS diff, (auroc_a - auroc_b) / sqrt(variance) AS z FROM t"""), doubles="auroc_a auroc_b diff variance z")(
    lambda s, d: paired.delong(predictions(s, d), "A", "B")
)
#: Tests to correct: in each dataset, whether an entity's errors depend on the kind of order; with two degrees of freedom the p of a
#: chi-square x is exp(-x / 2).
TESTS_SQL = """cells AS (SELECT dataset AS family, entity AS name, kind, (y_true <> y_pred)::INT AS wrong, count(*)::DOUBLE AS c FROM pred GROUP BY ALL),
 shares AS (SELECT family, name, c * c / (sum(c) OVER (PARTITION BY family, name, kind) * sum(c) OVER (PARTITION BY family, name, wrong)) AS s, sum(c) OVER (PARTITION BY family, name) AS n FROM cells),
 tests AS (SELECT family, name, round(exp(-(sum(s) - 1e0) * max(n) / 2e0), 9) AS p FROM shares GROUP BY ALL)"""


def kind_tests(s: SparkSession, d: str) -> DataFrame:
    cells = predictions(s, d).groupBy(F.col("dataset").alias("family"), F.col("entity").alias("name"), "kind", (F.col("y_true") != F.col("y_pred")).alias("wrong")).agg(F.count("*").cast("double").alias("c"))
    total = lambda *k: F.sum("c").over(Window.partitionBy("family", "name", *k))
    shares = cells.select("family", "name", (F.col("c") * F.col("c") / (total("kind") * total("wrong"))).alias("s"), total().alias("n"))
    return shares.groupBy("family", "name").agg(F.round(F.exp(-(F.sum("s") - 1) * F.max("n") / 2), 9).alias("p"))


_register("holm", _p(f", {TESTS_SQL}, r AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p) AS r FROM tests WINDOW w AS (PARTITION BY family ORDER BY p, name)) SELECT family, name, p, max(r) OVER (PARTITION BY family ORDER BY p, name) AS p_holm FROM r"), "family name", doubles="p p_holm")(lambda s, d: paired.holm(kind_tests(s, d)))
_register("bh", _p(f", {TESTS_SQL}, r AS (SELECT *, least(1e0, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, name)) AS r FROM tests) SELECT family, name, p, min(r) OVER (PARTITION BY family ORDER BY p DESC, name DESC) AS p_bh FROM r"), "family name", doubles="p p_bh")(lambda s, d: paired.benjamini_hochberg(kind_tests(s, d)))


def _erfc(x: str) -> str:
    """SQL for the complementary error function of a column x >= 0: a series below 2, a continued fraction above."""
    series = f"1e0 - exp(-{x} * {x}) * list_sum(list_transform(range(0, 60), lambda n: pow({x}, 2 * n + 1) / gamma(n + 15e-1)))"
    fraction = f"exp(-{x} * {x}) / sqrt(pi()) / list_reduce(list_prepend({x}, list_transform(range(400, 0, -1), lambda k: k::DOUBLE)), lambda a, k: {x} + k / 2e0 / a)"
    return f"CASE WHEN {x} < 2e0 THEN {series} ELSE {fraction} END"


#: Every test that a comparison holds: McNemar of pairs with a model, DeLong of the two models.
ALL_TESTS = f"""{PAIRS}, mc AS (SELECT *, (b_count + c_count) AS m, CASE WHEN b_count + c_count < 25 THEN b_count::DOUBLE ELSE (abs(b_count - c_count) - 1e0) * (abs(b_count - c_count) - 1e0) / (b_count + c_count) END AS statistic,
   (b_count - c_count) / n::DOUBLE AS acc_diff, sqrt(b_count + c_count - (b_count - c_count)::DOUBLE * (b_count - c_count) / n) / n AS se, b_count / c_count::DOUBLE AS odds, sqrt(1e0 / b_count + 1e0 / c_count) AS sl FROM pairs WHERE name_a IN ('A', 'B')),
 mx AS (SELECT *, CASE WHEN m >= 25 THEN sqrt(statistic / 2e0) ELSE 0e0 END AS x FROM mc),
 places AS (SELECT p.entity, p.sample_id, p.y_true, (count(*) FILTER (y_true = 0) OVER (PARTITION BY entity ORDER BY y_prob) - count(*) FILTER (y_true = 0) OVER (PARTITION BY entity, y_prob) / 2e0) / count(*) FILTER (y_true = 0) OVER (PARTITION BY entity) AS v1,
   1 - (count(*) FILTER (y_true = 1) OVER (PARTITION BY entity ORDER BY y_prob) - count(*) FILTER (y_true = 1) OVER (PARTITION BY entity, y_prob) / 2e0) / count(*) FILTER (y_true = 1) OVER (PARTITION BY entity) AS v0 FROM pred p WHERE y_prob IS NOT NULL),
 pv AS (SELECT entity, sample_id, y_true, CASE WHEN y_true = 1 THEN v1 ELSE v0 END AS v FROM places),
 st AS (SELECT a.y_true, count(*) AS n, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) + var_samp(b.v) - 2 * covar_samp(a.v, b.v) AS s FROM pv a JOIN pv b ON a.sample_id = b.sample_id AND a.entity = 'A' AND b.entity = 'B' GROUP BY ALL),
 dl AS (SELECT max(ma) FILTER (y_true = 1) AS auroc_a, max(mb) FILTER (y_true = 1) AS auroc_b, sum(s / n) AS variance, sum(n) AS n FROM st),
 dx AS (SELECT *, (auroc_a - auroc_b) / sqrt(variance) AS z, abs(auroc_a - auroc_b) / sqrt(2e0 * variance) AS x FROM dl),
 tests AS (SELECT name_a, name_b, CASE WHEN name_b = 'B' THEN 'model vs model' ELSE 'model vs rule' END AS comparison_type, 'mcnemar' AS test, 'point' AS family, CASE WHEN b_count > c_count THEN name_a WHEN b_count < c_count THEN name_b END AS better, statistic,
   CASE WHEN m = 0 THEN 1e0 WHEN m < 25 THEN least(1e0, 2e0 * list_sum(list_transform(range(0, least(b_count, c_count) + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2e0))))) ELSE {_erfc('x')} END AS p_value,
   n AS n_total, b_count AS discordant_b, c_count AS discordant_c, acc_diff, acc_diff - {Z} * se AS acc_lo, acc_diff + {Z} * se AS acc_hi, odds, odds * exp(-{Z} * sl) AS odds_lo, odds * exp({Z} * sl) AS odds_hi, NULL::DOUBLE AS auroc_a, NULL::DOUBLE AS auroc_b, NULL::DOUBLE AS auroc_diff FROM mx
  UNION ALL SELECT 'A', 'B', 'model vs model', 'delong', 'auroc', CASE WHEN z > 0 THEN 'A' WHEN z < 0 THEN 'B' END, z, {_erfc('x')}, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, auroc_a, auroc_b, auroc_a - auroc_b FROM dx)"""
_register("pairwise_full", _p(f""", {ALL_TESTS}, r AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p_value) AS r FROM tests WINDOW w AS (PARTITION BY family ORDER BY p_value, name_a, name_b)),
 h AS (SELECT *, max(r) OVER (PARTITION BY family ORDER BY p_value, name_a, name_b) AS p_value_corrected FROM r) SELECT *, p_value_corrected <= 5e-2 AS significant FROM h"""), "name_a name_b comparison_type test family better significant", "n_total discordant_b discordant_c", "statistic p_value acc_diff acc_lo acc_hi odds odds_lo odds_hi auroc_a auroc_b auroc_diff p_value_corrected")(lambda s, d: paired.compare(predictions(s, d)))
_register("q_matrix", _p(f""", {ALL_TESTS}, r AS (SELECT *, least(1e0, p_value * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p_value, name_a, name_b)) AS r FROM tests),
 h AS (SELECT name_a, name_b, -log10(greatest(min(r) OVER (PARTITION BY family ORDER BY p_value DESC, name_a DESC, name_b DESC), 1e-10)) AS q FROM r) SELECT name_a, """ + ", ".join(f"min(q) FILTER (name_b = '{b}') AS {b}" for b in ("B", "R1", "R2", "R3")) + " FROM h GROUP BY name_a"), "name_a", doubles="B R1 R2 R3")(
    lambda s, d: paired.q_matrix(paired.compare(predictions(s, d), "bh"), ["B", "R1", "R2", "R3"])
)
_register("best_entity", _p(f", {MID.format(k='entity')} SELECT entity, auroc FROM ({AUC.format(k='entity')}) ORDER BY auroc DESC, entity LIMIT 1"), "entity", doubles="auroc")(lambda s, d: metrics.auroc(predictions(s, d), ["entity"]).orderBy(F.desc("auroc"), "entity").limit(1))
_register("main_comparisons", _p(f", {PAIRS} SELECT name_b, b_count, c_count FROM pairs WHERE name_a = 'A' AND name_b LIKE 'R%'"), "name_b", "b_count c_count")(lambda s, d: paired.pairs(predictions(s, d)).where("name_a = 'A' and name_b like 'R%'").select("name_b", "b_count", "c_count"))

# intervals
#: Replicates of the queries that draw by hashes.
REPLICATES = 1000
WEIGHT = " + ".join(f"(h >= {t})::INT" for t in replicates.STEPS)
DRAWN = f"""reps AS (SELECT r AS replicate, ('0x' || substr(m, 1, 8))::BIGINT % {replicates.PRIME} AS ra, ('0x' || substr(m, 9, 8))::BIGINT % {replicates.PRIME} AS rb, ('0x' || substr(m, 17, 8))::BIGINT % {replicates.PRIME} AS rc FROM (SELECT r, md5('boot|' || r) AS m FROM range({REPLICATES}) t(r))),
 rows AS (SELECT *, ('0x' || substr(md5('boot:' || sample_id), 1, 8))::BIGINT % {replicates.PRIME} AS x FROM pred)"""
HASH = f"((ra * x + rb) % {replicates.PRIME} * x + rc) % {replicates.PRIME}"
BOOT = f"""{DRAWN}, got AS (SELECT entity, replicate, y_true, y_pred, {WEIGHT} AS w FROM (SELECT entity, replicate, y_true, y_pred, {HASH} AS h FROM rows, reps)),
 sums AS (SELECT entity, replicate, sum(w * y_true * y_pred) AS tp, sum(w * (1 - y_true) * y_pred) AS fp, sum(w * (1 - y_true) * (1 - y_pred)) AS tn, sum(w * y_true * (1 - y_pred)) AS fn FROM got GROUP BY ALL),
 boot AS (SELECT entity, replicate, {ALL} FROM sums WHERE tp + fn > 0 AND fp + tn > 0)"""
_register("bootstrap_percentile", _p(f", {BOOT} SELECT entity, avg(mcc) AS mean, quantile_cont(mcc, 0.025) AS lower, quantile_cont(mcc, 0.975) AS upper FROM boot GROUP BY entity"), "entity", doubles="mean lower upper")(lambda s, d: intervals.percentile_interval(replicates.count_replicates(predictions(s, d), REPLICATES), "mcc"))
JACK = "per AS (SELECT entity, ('0x' || substr(md5('jack:' || sample_id), 1, 8))::BIGINT % 20 AS block, count(*) AS n, count(*) FILTER (y_true = y_pred) AS k FROM pred GROUP BY ALL), jack AS (SELECT entity, block, (sum(k) OVER e - k) / (sum(n) OVER e - n)::DOUBLE AS accuracy FROM per WINDOW e AS (PARTITION BY entity))"
_register("jackknife_blocks", _p(f", {JACK} SELECT * FROM jack"), "entity", "block", "accuracy")(lambda s, d: intervals.jackknife(predictions(s, d)))
_register("bca_acceleration", _p(f", {JACK}, dev AS (SELECT entity, avg(accuracy) OVER (PARTITION BY entity) - accuracy AS d FROM jack) SELECT entity, coalesce(sum(d * d * d) / nullif(6e0 * pow(sum(d * d), 15e-1), 0e0), 0e0) AS a FROM dev GROUP BY entity"), "entity", doubles="a")(lambda s, d: intervals.acceleration(intervals.jackknife(predictions(s, d))))
_register("bca_intervals", None)(lambda s, d: intervals.all_intervals(predictions(s, d), ["entity"]))
_register("cliffs_delta", _p(f", {MID.format(k='entity')} SELECT entity, auroc, 2e0 * auroc - 1e0 AS delta, CASE WHEN abs(2e0 * auroc - 1e0) < 147e-3 THEN 'negligible' WHEN abs(2e0 * auroc - 1e0) < 33e-2 THEN 'small' WHEN abs(2e0 * auroc - 1e0) < 474e-3 THEN 'medium' ELSE 'large' END AS band FROM ({AUC.format(k='entity')})"), "entity band", doubles="auroc delta")(lambda s, d: intervals.cliffs_delta(metrics.auroc(predictions(s, d), ["entity"])))

# profile
CONT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
line = lambda s, d: table(s, d, "lineitem")
_register("feature_profile", "SELECT feature, count(value) AS n, count(*) FILTER (value IS NULL) AS n_null, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM lineitem" for c in CONT) + ") GROUP BY feature", "feature", "n n_null", "mean std least most q25 median q75")(lambda s, d: profile.continuous(line(s, d), CONT))
CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_register("categorical_profile", "WITH c AS (SELECT feature, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS value FROM lineitem" for c in CATS) + ") WHERE value IS NOT NULL GROUP BY ALL) SELECT feature, count(*) AS n_unique, (list(value ORDER BY n DESC, value))[1] AS top, max(n) AS top_count FROM c GROUP BY feature", "feature top", "n_unique top_count")(lambda s, d: profile.categorical(line(s, d), CATS))
lab = lambda s, d: line(s, d).withColumn("y", (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30000).cast("int"))
LAB = "lab AS (SELECT *, (l_extendedprice * (1 - l_discount) > 30000)::INT AS y FROM lineitem)"
_register("target_corr", f"WITH {LAB} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}::DOUBLE, y::DOUBLE) AS corr FROM lab" for c in CONT), "feature", doubles="corr")(lambda s, d: profile.target_correlation(lab(s, d), CONT, "y"))
_register("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}::DOUBLE, {b}::DOUBLE) AS corr FROM lineitem" for i, a in enumerate(CONT) for b in CONT[i + 1 :]), "a b", doubles="corr")(lambda s, d: profile.correlation_matrix(line(s, d), CONT))
_register("class_balance", f"WITH {BASE} SELECT dataset, y_true AS y, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS share FROM base GROUP BY dataset, y_true", "dataset", "y n", "share")(lambda s, d: profile.balance(base(s, d), ["dataset"], "y_true"))
_register("class_imbalance", f"WITH {BASE}, holed AS (SELECT dataset, CASE WHEN sample_id % 11 <> 0 THEN y_true END AS y FROM base), c AS (SELECT dataset, y, count(*) AS n FROM holed GROUP BY ALL) SELECT dataset, sum(n) AS n, coalesce(sum(n) FILTER (y IS NULL), 0) AS n_missing, max(n) FILTER (y IS NOT NULL) AS majority, min(n) FILTER (y IS NOT NULL) AS minority, max(n) FILTER (y IS NOT NULL) / min(n) FILTER (y IS NOT NULL) AS ratio FROM c GROUP BY dataset", "dataset", "n n_missing majority minority", "ratio")(
    lambda s, d: profile.imbalance(base(s, d).withColumn("y_true", F.when(F.col("sample_id") % 11 != 0, F.col("y_true"))), ["dataset"], "y_true")
)
_register("length_summary", "SELECT l_returnflag AS kind, count(l_quantity) AS n, avg(l_quantity) AS mean, quantile_cont(l_quantity::DOUBLE, 0.5) AS median, stddev_samp(l_quantity) AS std, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY ALL", "kind", "n", "mean median std least most")(lambda s, d: profile.length_summary(line(s, d).withColumnRenamed("l_returnflag", "kind"), ["kind"], "l_quantity"))
_register("min_samples_check", f"WITH {BASE} SELECT sum(n) AS rows, count(y_true) AS classes, min(n) AS minority, 0 AS missing, 10 AS needed, min(n) >= 10 AND count(*) >= 2 AS ok FROM (SELECT y_true, count(*) AS n FROM base GROUP BY y_true)", "ok", "rows classes minority missing needed")(lambda s, d: folds.check(base(s, d), "y_true", 10, 5))
_register("compatibility", f"WITH {BASE} SELECT dataset, string_agg(DISTINCT y_true::VARCHAR, ',' ORDER BY y_true::VARCHAR) AS classes, 5 AS n_features, 5 AS n_common, true AS ok FROM base GROUP BY dataset", "dataset classes ok", "n_features n_common")(
    lambda s, d: profile.compatibility(base(s, d), {k: ["pa", "pb", "R1", "R2", "R3"] for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}, "y_true")
)


# cleaning: a tenth of the prices is missing
def holes(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(_u("null") >= 0.1, F.col("o_totalprice")).alias("x"), F.when(_u("null2") >= 0.1, F.col("o_orderpriority")).alias("c"), F.col("o_totalprice").alias("z"), (F.col("o_totalprice") > 200000).cast("int").alias("y_true"))
    return folds.stratified(o, 10, "y_true", "sample_id")


HOLES = f"h0 AS (SELECT o_orderkey AS sample_id, CASE WHEN {_u_sql('null')} >= 1e-1 THEN o_totalprice END AS x, CASE WHEN {_u_sql('null2')} >= 1e-1 THEN o_orderpriority END AS c, o_totalprice AS z, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS y_true FROM orders), holes AS (SELECT *, ((row_number() OVER (PARTITION BY y_true ORDER BY md5('42:' || sample_id), sample_id) - 1) % 10)::INT AS fold FROM h0)"
_register("missing_pct", f"WITH {HOLES} SELECT 100e0 * (count(*) FILTER (x IS NULL) + count(*) FILTER (c IS NULL)) / (2 * count(*)) AS missing_pct FROM holes", doubles="missing_pct")(lambda s, d: clean.share_missing(holes(s, d), ["x", "c"]))
_register("drop_missing", f"WITH {HOLES} SELECT sample_id, x, c FROM holes WHERE x IS NOT NULL AND c IS NOT NULL", "c", "sample_id", "x")(lambda s, d: clean.drop_missing(holes(s, d), ["x", "c"]).select("sample_id", "x", "c"))
for _n, _e in (("median", "quantile_cont(x, 0.5)"), ("mean", "avg(x)")):
    _register(f"impute_{_n}", f"WITH {HOLES}, fill AS (SELECT f.fold, {_e} AS v FROM range(10) f(fold) JOIN holes h ON h.fold <> f.fold GROUP BY f.fold) SELECT sample_id, coalesce(x, v) AS x FROM holes JOIN fill USING (fold)", "", "sample_id", "x")(lambda s, d, n=_n: clean.imputed(holes(s, d), ["x"], n, 10).select("sample_id", "x"))
_register("impute_mode", f"WITH {HOLES}, n AS (SELECT f.fold, c, count(*) AS n FROM range(10) f(fold) JOIN holes h ON h.fold <> f.fold WHERE c IS NOT NULL GROUP BY ALL), fill AS (SELECT fold, (list(c ORDER BY n DESC, c))[1] AS v FROM n GROUP BY fold) SELECT sample_id, coalesce(c, v) AS c FROM holes JOIN fill USING (fold)", "c", "sample_id")(lambda s, d: clean.imputed(holes(s, d), ["c"], "most_frequent", 10).select("sample_id", "c"))
_register("standard_scale", f"WITH {HOLES}, fill AS (SELECT f.fold, avg(z) AS m, stddev_pop(z) AS s FROM range(10) f(fold) JOIN holes h ON h.fold <> f.fold GROUP BY f.fold) SELECT sample_id, (z - m) / coalesce(nullif(s, 0e0), 1e0) AS z FROM holes JOIN fill USING (fold)", "", "sample_id", "z")(lambda s, d: clean.scaled(holes(s, d), ["z"], 10).select("sample_id", "z"))
_register("dedup_keep_first", "SELECT o_orderpriority, o_orderstatus, o_custkey % 50 AS g, min(o_orderkey) AS first_id FROM orders GROUP BY ALL", "o_orderpriority o_orderstatus", "g first_id")(
    lambda s, d: clean.distinct_first(table(s, d, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("first_id")), ["o_orderpriority", "o_orderstatus", "g"], "first_id")
)
_register("partition_by_flag", f"WITH {BASE} SELECT kind, count(*) AS n, sum(y_true) AS n_pos FROM (SELECT 'one' AS kind, y_true FROM base WHERE R1 = 1 UNION ALL SELECT 'two', y_true FROM base WHERE R2 = 1) GROUP BY kind", "kind", "n n_pos")(lambda s, d: clean.by_flag(base(s, d), {"R1": "one", "R2": "two"}).groupBy("kind").agg(F.count("*").alias("n"), F.sum("y_true").alias("n_pos")))
_register("union_pool", f"WITH {BASE} SELECT d AS dataset, count(*) AS n, count(pb) AS n_pb FROM (SELECT 'x' AS d, pa, pb FROM base WHERE kind = 'F' UNION ALL SELECT 'y', pa, NULL FROM base WHERE kind = 'O') GROUP BY d", "dataset", "n n_pb")(lambda s, d: clean.pooled([(base(s, d).where("kind = 'F'"), "x"), (base(s, d).where("kind = 'O'").drop("pb"), "y")]).groupBy("dataset").agg(F.count("*").alias("n"), F.count("pb").alias("n_pb")))
_register("lodo_pool", f"WITH {BASE} SELECT h.dataset AS held_out, count(*) AS n, sum(b.y_true) AS n_pos FROM (SELECT DISTINCT dataset FROM base) h JOIN base b ON b.dataset <> h.dataset GROUP BY ALL", "held_out", "n n_pos")(lambda s, d: clean.pooled([(clean.others(base(s, d), x), x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "held_out").groupBy("held_out").agg(F.count("*").alias("n"), F.sum("y_true").alias("n_pos")))

# splits
_register("stratified_folds", f"WITH {BASE} SELECT sample_id, fold FROM base", "", "sample_id fold")(lambda s, d: folded_base(s, d).select("sample_id", "fold"))
_register("aligned_folds", f"WITH {BASE} SELECT sample_id, dataset, (row_number() OVER (PARTITION BY dataset, y_true ORDER BY md5('7:' || sample_id), sample_id) - 1) % 5 AS fold FROM base", "dataset", "sample_id fold")(lambda s, d: folds.stratified(base(s, d), 5, "y_true", "sample_id", 7, ("dataset",)).select("sample_id", "dataset", "fold"))
_register("stratified_holdout", f"WITH {BASE}, r AS (SELECT sample_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY md5('42:' || sample_id), sample_id) AS rn, count(*) OVER (PARTITION BY y_true) AS n FROM base) SELECT sample_id, (rn <= round(n * 2e-1))::INT AS test FROM r", "", "sample_id test")(lambda s, d: folds.holdout(base(s, d), 0.2, "y_true", "sample_id").select("sample_id", "test"))


# transfer: a rule's value on (source, target, fold) mixes its accuracies on both
def cell_values(s: SparkSession, d: str) -> DataFrame:
    acc = folded(s, d).groupBy("entity", "dataset", "fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("v"))
    a, b = acc.alias("a"), acc.alias("b")
    own = F.col("a.dataset") == F.col("b.dataset")
    out = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.fold") == F.col("b.fold")))
    return out.select(F.col("a.entity").alias("model"), F.lit("accuracy").alias("metric"), F.col("a.dataset").alias("source"), F.col("b.dataset").alias("target"), F.col("a.fold").alias("fold"), F.when(own, F.col("a.v")).otherwise(F.lit(0.5) * F.col("a.v") + F.lit(0.4) * F.col("b.v")).alias("value"))


CELLS = ", acc AS (SELECT entity, dataset, fold, avg((y_true = y_pred)::INT) AS v FROM pred GROUP BY ALL), fv AS (SELECT a.entity AS model, 'accuracy' AS metric, a.dataset AS source, b.dataset AS target, a.fold, CASE WHEN a.dataset = b.dataset THEN a.v ELSE 5e-1 * a.v + 4e-1 * b.v END AS value FROM acc a JOIN acc b ON a.entity = b.entity AND a.fold = b.fold), cell AS (SELECT model, metric, source, target, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n_folds FROM fv GROUP BY ALL)"
cell_table = lambda s, d: transfer.cells(cell_values(s, d))
_register("cell_matrix", _p(f"{CELLS} SELECT * FROM cell"), "model metric source target", "n_folds", "mean std")(cell_table)
_register("generalization_gap", _p(f"{CELLS}, per AS (SELECT model, metric, source, fold, max(value) FILTER (source = target) AS own, avg(value) FILTER (source <> target) AS xx FROM fv GROUP BY ALL) SELECT model, metric, source, avg(own - xx) AS gap, count(*) AS n_folds FROM per GROUP BY ALL"), "model metric source", "n_folds", "gap")(lambda s, d: transfer.gap(cell_values(s, d)))
_register("same_vs_cross", _p(f"{CELLS} SELECT model, metric, avg(mean) FILTER (source = target) AS same, avg(mean) FILTER (source <> target) AS cross_, stddev_samp(mean) FILTER (source <> target) AS spread, avg(mean) FILTER (source = target) - avg(mean) FILTER (source <> target) AS gap FROM cell GROUP BY ALL"), "model metric", doubles="same cross_ spread gap")(lambda s, d: transfer.same_and_cross(cell_table(s, d)).withColumnRenamed("cross", "cross_"))
_register("best_worst_cells", _p(f"{CELLS} SELECT * FROM (SELECT model, metric, source, target, mean, row_number() OVER (PARTITION BY model, metric ORDER BY round(mean, 9) DESC, source, target) AS best_rank, row_number() OVER (PARTITION BY model, metric ORDER BY round(mean, 9), source, target) AS worst_rank FROM cell WHERE source <> target) WHERE best_rank <= 3 OR worst_rank <= 3"), "model metric source target", "best_rank worst_rank", "mean")(lambda s, d: transfer.best_and_worst(cell_table(s, d).withColumn("mean", F.round("mean", 9))))
_register("target_difficulty", _p(f"{CELLS} SELECT model, metric, target, avg(mean) AS mean FROM cell WHERE source <> target GROUP BY ALL"), "model metric target", doubles="mean")(lambda s, d: transfer.difficulty(cell_table(s, d)))
_register("stability", _p(f"{CELLS} SELECT model, 1e0 / (1e0 + avg(std)) AS stability FROM cell GROUP BY model"), "model", doubles="stability")(lambda s, d: transfer.stability(cell_table(s, d)))
SCORED = "scored AS (SELECT entity, dataset AS target, fold, y_true, y_prob, rank() OVER w + (count(*) OVER (PARTITION BY entity, dataset, fold, y_prob) - 1) / 2e0 AS r FROM pred WHERE y_prob IS NOT NULL WINDOW w AS (PARTITION BY entity, dataset, fold ORDER BY y_prob))"
_register("cross_cells", _p(f""", tr AS (SELECT entity, dataset AS source, f AS fold, y_true, y_prob FROM pred, range(10) t(f) WHERE fold <> f AND y_prob IS NOT NULL),
 {_youden_sql('entity, source, fold').replace('FROM pred WHERE y_prob IS NOT NULL', 'FROM tr')},
 hard AS (SELECT p.entity, y.source, p.dataset AS target, p.fold, p.y_true, (p.y_prob >= CASE WHEN y.j > 0 THEN y.threshold ELSE 5e-1 END)::INT AS y_pred FROM pred p JOIN youden y ON p.entity = y.entity AND p.fold = y.fold WHERE p.y_prob IS NOT NULL),
 wide AS (SELECT entity, source, target, fold, {ALL} FROM ({_counts('entity, source, target, fold', 'hard')})), {SCORED},
 auc AS (SELECT entity, target, fold, (sum(CASE WHEN y_true = 1 THEN r ELSE 0e0 END) - sum(y_true) * (sum(y_true) + 1) / 2e0) / nullif(sum(y_true) * (count(*) - sum(y_true)), 0) AS auroc, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM scored GROUP BY ALL),
 bins AS (SELECT entity, target, fold, {BIN} AS bin, count(*) AS n, abs(avg(y_true) - avg(y_prob)) AS gap FROM scored GROUP BY ALL), err AS (SELECT entity, target, fold, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM bins GROUP BY ALL),
 every AS (SELECT w.*, a.auroc, a.brier, e.ece, e.mce FROM wide w JOIN auc a USING (entity, target, fold) JOIN err e USING (entity, target, fold)),
 vals AS (UNPIVOT every ON {', '.join(METRICS)}, auroc, brier, ece, mce INTO NAME metric VALUE value)
 SELECT entity AS model, metric, source, target, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n_folds FROM vals GROUP BY ALL"""), "model metric source target", "n_folds", "mean std")(lambda s, d: transfer.cells(transfer.carried(folded(s, d), 10)))

# shift
_register("class_priors", f"WITH {BASE} SELECT dataset, count(y_true) AS n, sum(y_true) AS n_pos, sum(1 - y_true) AS n_neg, avg(y_true) AS positive_rate FROM base GROUP BY dataset", "dataset", "n n_pos n_neg", "positive_rate")(lambda s, d: profile.class_priors(base(s, d), "y_true"))
_register("feature_types", "SELECT * FROM (VALUES ('pa', 'continuous'), ('R1', 'binary'), ('R2', 'continuous'), ('sample_id', 'continuous')) t(feature, type)", "feature type")(lambda s, d: shift.feature_types(base(s, d), ["pa", "R1", "R2", "sample_id"], ("R2",)))
KS = """cells AS (SELECT dataset, 'pa' AS feature, pa AS value FROM base UNION ALL SELECT dataset, 'pb', pb FROM base), tot AS (SELECT feature, dataset, count(*) AS t FROM cells GROUP BY ALL),
 prs AS (SELECT a.feature, a.dataset AS a, b.dataset AS b, a.t AS ta, b.t AS tb FROM tot a JOIN tot b ON a.feature = b.feature AND a.dataset < b.dataset),
 steps AS (SELECT p.feature, p.a, p.b, c.value, sum(CASE WHEN c.dataset = p.a THEN 1e0 / ta WHEN c.dataset = p.b THEN -1e0 / tb ELSE 0e0 END) AS step FROM prs p JOIN cells c ON c.feature = p.feature AND c.dataset IN (p.a, p.b) GROUP BY ALL),
 ks AS (SELECT a, b, feature, max(abs(run)) AS distance FROM (SELECT *, sum(step) OVER (PARTITION BY feature, a, b ORDER BY value) AS run FROM steps) GROUP BY ALL)"""
_register("ks_shift", f"WITH {BASE}, {KS} SELECT * FROM ks", "a b feature", doubles="distance")(lambda s, d: shift.ks(base(s, d), ["pa", "pb"]))
PROP = "m AS (SELECT dataset, 'R1' AS feature, avg(R1) AS m FROM base GROUP BY dataset UNION ALL SELECT dataset, 'R2', avg(R2) FROM base GROUP BY dataset), prop AS (SELECT a.dataset AS a, b.dataset AS b, a.feature, abs(a.m - b.m) AS distance FROM m a JOIN m b ON a.feature = b.feature AND a.dataset < b.dataset)"
_register("prop_shift", f"WITH {BASE}, {PROP} SELECT * FROM prop", "a b feature", doubles="distance")(lambda s, d: shift.proportion(base(s, d), ["R1", "R2"]))
_register("shift_pivot", f"WITH {BASE}, {KS} SELECT feature, max(distance) FILTER (a = '1-URGENT' AND b = '2-HIGH') AS urgent_high, max(distance) FILTER (a = '1-URGENT' AND b = '5-LOW') AS urgent_low FROM ks GROUP BY feature", "feature", doubles="urgent_high urgent_low")(
    lambda s, d: shift.ks(base(s, d), ["pa", "pb"]).withColumn("pair", F.concat_ws(" vs ", "a", "b")).groupBy("feature").pivot("pair", ["1-URGENT vs 2-HIGH", "1-URGENT vs 5-LOW"]).agg(F.max("distance")).toDF("feature", "urgent_high", "urgent_low")
)

# errors
WRONG = ", wrong AS (SELECT *, least(greatest(margin / side, 0e0), 1e0) AS confidence FROM (SELECT *, abs(y_prob - threshold) AS margin, CASE WHEN y_prob >= threshold THEN greatest(1e0 - threshold, 2220446049250313e-31) ELSE greatest(threshold, 2220446049250313e-31) END AS side FROM pred WHERE y_prob IS NOT NULL AND y_true <> y_pred)), cuts(cut) AS (VALUES (6e-1), (7e-1), (8e-1), (9e-1), (95e-2))"


def _cut_sql(k: str) -> str:
    on = " AND ".join(f"w.{c} = g.{c}" for c in k.split(", "))
    return f""", g AS (SELECT {k}, cut, count(*) AS rows_ FROM pred, cuts WHERE y_prob IS NOT NULL GROUP BY ALL), e AS (SELECT {k}, count(*) AS errors FROM wrong GROUP BY ALL),
 bycut AS (SELECT {', '.join('g.' + c for c in k.split(', '))}, g.cut, count(w.confidence) AS n, 100e0 * count(w.confidence) / any_value(g.rows_) AS pct, coalesce(100e0 * count(w.confidence) / any_value(e.errors), 0e0) AS pct_errors, coalesce(avg(w.confidence), 0e0) AS mean_confidence, coalesce(stddev_samp(w.confidence), 0e0) AS std_confidence, coalesce(avg(w.margin), 0e0) AS mean_margin FROM g LEFT JOIN e USING ({k}) LEFT JOIN wrong w ON {on} AND w.confidence >= g.cut GROUP BY ALL)"""


_register("misclassified", _p(f"{WRONG} SELECT entity, sample_id, margin, confidence FROM wrong"), "entity", "sample_id", "margin confidence")(lambda s, d: errors.misclassified(predictions(s, d)).select("entity", "sample_id", "margin", "confidence"))
_register("errors_by_cut", _p(f"{WRONG}{_cut_sql('entity')} SELECT * FROM bycut"), "entity", "n", "cut pct pct_errors mean_confidence std_confidence mean_margin")(lambda s, d: errors.by_cut(predictions(s, d), ["entity"]))
_register("errors_by_class", _p(f"{WRONG} SELECT entity, cut, y_true, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER (PARTITION BY entity, cut) AS pct, avg(confidence) AS mean_confidence, coalesce(stddev_samp(confidence), 0e0) AS std_confidence, mode(y_pred) AS confused_with, count(*) AS confused_n FROM wrong JOIN cuts ON confidence >= cut GROUP BY entity, cut, y_true"), "entity", "y_true n confused_with confused_n", "cut pct mean_confidence std_confidence")(lambda s, d: errors.by_class(predictions(s, d), ["entity"]))
_register("error_report", _p(f"{WRONG}{_cut_sql('entity, fold')} SELECT entity, cut, avg(n) AS mean_n, stddev_pop(n) AS std_n, avg(pct) AS mean_pct, stddev_pop(pct) AS std_pct, coalesce(avg(mean_confidence) FILTER (mean_confidence > 0), 0e0) AS mean_confidence, coalesce(avg(mean_margin) FILTER (mean_margin > 0), 0e0) AS mean_margin, coalesce((SELECT count(*) FROM wrong w WHERE w.entity = bycut.entity AND w.confidence >= bycut.cut AND w.y_true = 0), 0) / count(*) AS mean_n_0, coalesce((SELECT count(*) FROM wrong w WHERE w.entity = bycut.entity AND w.confidence >= bycut.cut AND w.y_true = 1), 0) / count(*) AS mean_n_1 FROM bycut GROUP BY entity, cut"), "entity", doubles="cut mean_n std_n mean_pct std_pct mean_confidence mean_margin mean_n_0 mean_n_1")(lambda s, d: errors.fold_report(folded(s, d)))
_register("fold_consistency", _p(f"{WRONG}{_cut_sql('entity, fold')} SELECT entity, fold, max(n) FILTER (cut = 6e-1) AS n_60, max(n) FILTER (cut = 9e-1) AS n_90 FROM bycut GROUP BY ALL"), "entity", "fold n_60 n_90")(lambda s, d: errors.by_cut(folded(s, d), ["entity", "fold"]).groupBy("entity", "fold").pivot("cut", [0.6, 0.9]).agg(F.max("n")).toDF("entity", "fold", "n_60", "n_90"))
_register("error_detail", _p(f"{WRONG} SELECT entity, count(*) AS n, sum(y_true) AS n_missed, avg(confidence) AS mean_confidence, stddev_samp(confidence) AS std_confidence, avg(margin) AS mean_margin, stddev_samp(margin) AS std_margin, quantile_cont(confidence, 0.25) AS q25, quantile_cont(confidence, 0.5) AS median, quantile_cont(confidence, 0.75) AS q75, quantile_cont(margin, 0.25) AS margin_q25, quantile_cont(margin, 0.5) AS margin_median, quantile_cont(margin, 0.75) AS margin_q75 FROM wrong GROUP BY entity"), "entity", "n n_missed", "mean_confidence std_confidence mean_margin std_margin q25 median q75 margin_q25 margin_median margin_q75")(lambda s, d: errors.detail(predictions(s, d)))
_register("errors_by_category", _p("SELECT entity, fold, kind, avg((y_true <> y_pred)::INT) AS share FROM pred GROUP BY ALL"), "entity kind", "fold", "share")(lambda s, d: errors.by_category(folded(s, d), "kind"))
_register("confidence_hist", _p(f"{WRONG} SELECT entity, least(floor(confidence * 30), 29) AS bin, count(*) AS n, 30e0 * count(*) / sum(count(*)) OVER (PARTITION BY entity) AS density FROM wrong GROUP BY entity, bin"), "entity", "bin n", "density")(lambda s, d: errors.histogram(predictions(s, d)))

# rankings
IMP = f", imp AS (SELECT entity, kind AS feature, fold, avg(y_pred) AS value FROM pred GROUP BY ALL), rk AS (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY mean DESC) AS rank FROM (SELECT entity, feature, round(avg(value), 9) AS mean, stddev_pop(value) AS std FROM imp GROUP BY ALL))"
imp = lambda s, d: transfer.importance_ranks(folded(s, d).groupBy("entity", F.col("kind").alias("feature"), "fold").agg(F.round(F.avg("y_pred"), 15).alias("value")))
_register("importance_rank", _p(f"{IMP} SELECT * FROM rk"), "entity feature", "rank", "mean std")(imp)
_register("top_frequency", _p(f"{IMP} SELECT feature, count(*) AS times FROM rk WHERE rank <= 2 GROUP BY feature"), "feature", "times")(lambda s, d: transfer.top_frequency(imp(s, d), 2))
_register("select_best_model", _p(f", {FOLD} SELECT entity, avg(value) AS mean FROM long WHERE metric = 'mcc' GROUP BY entity ORDER BY mean DESC LIMIT 1"), "entity", doubles="mean")(lambda s, d: transfer.best_model(fold_metrics(s, d).where("metric = 'mcc'")))
_register("best_per_metric", _p(f", {FOLD}, a AS (SELECT metric, entity, avg(value) AS mean FROM long GROUP BY ALL) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY metric ORDER BY mean DESC, entity) = 1"), "metric entity", doubles="mean")(lambda s, d: transfer.best_per_metric(fold_metrics(s, d)))
ABL = f", {FOLD}, s AS (SELECT b.metric AS name, b.fold, b.value AS baseline, a.value AS ablated FROM long b JOIN long a ON a.metric = b.metric AND a.fold = b.fold AND a.entity = 'B' AND b.entity = 'A'), q AS (SELECT name, avg(baseline) AS b, avg(ablated) AS a, stddev_samp(baseline) AS sb, stddev_samp(ablated) AS sa, stddev_samp(baseline - ablated) AS sd, count(*) AS n FROM s GROUP BY name)"
_register("ablation_stats", _p(f"{ABL} SELECT name, b AS baseline, a AS ablated, b - a AS delta, coalesce(100e0 * (b - a) / nullif(b, 0e0), 0e0) AS delta_pct, (b - a) / (sd / sqrt(n)) AS t, (b - a) / sqrt((sb * sb + sa * sa) / 2e0) AS d_av FROM q"), "name", doubles="baseline ablated delta delta_pct t d_av")(
    lambda s, d: transfer.ablation(fold_metrics(s, d).where("entity in ('A', 'B')").groupBy(F.col("metric").alias("name"), "fold").agg(F.max(F.when(F.col("entity") == "A", F.col("value"))).alias("baseline"), F.max(F.when(F.col("entity") == "B", F.col("value"))).alias("ablated"))).drop("n")
)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of every entity."""
    return tidy(metrics.all_metrics(predictions(spark, d), ["entity"]))


# training: a label that follows from price and discount
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def learnable(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.xxhash64(*table(s, d, "lineitem").columns).alias("sample_id"), *[F.col(f).cast("double").alias(f) for f in FEATURES], F.col("l_returnflag").alias("dataset"))
    return rows.withColumn("y", (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30000).cast("int"))


def _trained(name: str, **params) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        from plumbline.operators import models

        rows = storage.kept(folds.holdout(learnable(s, d).select("sample_id", *FEATURES, "y"), 0.2, "y", "sample_id").drop("sample_id"))
        out = models.score(models.fit(rows.where("test = 0"), FEATURES, "y", name, **params), rows.where("test = 1"), FEATURES)
        return metrics.auroc(out.select(F.lit(name).alias("entity"), F.col("y").alias("y_true"), "y_prob"), ["entity"])

    return run


_register("train_lr", None)(_trained("logistic", regParam=0.001))
_register("train_rf", None)(_trained("forest", numTrees=50, maxDepth=5))
_register("train_gbt", None)(_trained("gbt", maxIter=50, maxDepth=3, stepSize=0.1))
_register("train_gbt_balanced", None)(_trained("gbt_balanced", maxIter=50, maxDepth=4, stepSize=0.1))
_register("train_mlp", None)(_trained("mlp", layers=(50,), activation="relu", alpha=1e-4, maxIter=60))


def _models(f: Callable) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        from plumbline.operators import models

        return f(models, s, learnable(s, d))

    return run


def _calibrated(m, s: SparkSession, rows: DataFrame) -> DataFrame:
    rows = storage.kept(folds.holdout(rows.select("sample_id", *FEATURES, "y"), 0.2, "y", "sample_id"))
    out = m.calibrated(rows.where("test = 0"), rows.where("test = 1"), FEATURES, "y", "logistic", regParam=0.001)
    return metrics.calibration_error(out.select(F.lit("logistic").alias("entity"), F.col("y").alias("y_true"), "y_prob"), ["entity"])


_register("calibrated_scores", None)(_models(_calibrated))
_register("cv_search", None)(_models(lambda m, s, rows: s.createDataFrame([(str(p), v) for p, v in m.search(rows, FEATURES, "y", "logistic")], "params string, auroc double")))
_register("out_of_fold", None)(_models(lambda m, s, rows: m.out_of_fold(rows, FEATURES, "y", "logistic", 3, regParam=0.001)))
_register("cross_dataset", None)(_models(lambda m, s, rows: transfer.cells(m.cross(rows, FEATURES, "y", "logistic", 2, strict=True, regParam=0.001))))
_register("lodo_train", None)(_models(lambda m, s, rows: m.held_out_datasets(rows, FEATURES, "y", m.Plan("logistic", {"regParam": 0.001}, tune=False), strict=True)))
_register("feature_ablation", None)(_models(lambda m, s, rows: transfer.ablation_tests(m.leave_out(rows, FEATURES, {f: [f] for f in FEATURES}, "y", "logistic", regParam=0.001))))
_register("step_ablation", None)(_models(lambda m, s, rows: transfer.ablation_tests(m.step_ablation(rows, FEATURES, "y", m.Plan("logistic", {"regParam": 0.001}, calibrate=3)))))


def _tree_shares(m, s: SparkSession, rows: DataFrame) -> DataFrame:
    from plumbline.operators import explain

    return explain.mean_shares(explain.explain(m.fit(rows, FEATURES, "y", "forest", numTrees=50, maxDepth=5), rows, FEATURES), [])


_register("shapley_trees", None)(_models(_tree_shares))
_register("shapley_linear", None)(_models(lambda m, s, rows: m.shapley_linear(rows, FEATURES, "y", regParam=0.001).select("sample_id", "base", F.aggregate(F.map_values("phi"), F.lit(0.0), lambda a, x: a + x).alias("total"), "margin")))


def _knn(s: SparkSession, d: str) -> DataFrame:
    from plumbline.operators import models

    v = table(s, d, "embeddings")
    return models.knn(v, v.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", "label")


KNN = "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS i, v.label, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, i) <= 5) SELECT query_id, count(*) FILTER (label = 1) AS n1, sum(i) AS id_sum FROM n GROUP BY query_id"
_register("knn_exact", KNN, "", "query_id n1 id_sum")(_knn)


def _knn_tree(s: SparkSession, d: str) -> DataFrame:
    """As `knn_exact`, by the metric tree: one neighbour more, for a query finds itself."""
    from plumbline.operators import metric_tree

    v = table(s, d, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"))
    near = metric_tree.nearest(v.where("vid % 20 = 0").select(F.col("vid").alias("qid"), F.col("v").alias("q")), v, 6).where("qid != vid")
    at = F.row_number().over(Window.partitionBy("qid").orderBy("d", "vid"))
    near = near.withColumn("at", at).where("at <= 5")
    return near.groupBy(F.col("qid").alias("query_id")).agg(F.count_if(F.col("y") == 1).alias("n1"), F.sum("vid").alias("id_sum"))


_register("knn_tree", KNN, "", "query_id n1 id_sum")(_knn_tree)


#: Newton steps that the SQL takes; the library stops when the gradient vanishes.
NEWTON = 12


def _sigmoid_sql() -> str:
    steps = []
    for k in range(NEWTON):
        z = "(i.a * x + i.b)"
        p = f"(1e0 / (1e0 + exp({z})))"
        d = f"(n1 * (t1 - {p}) + n0 * (t0 - {p}))"
        w = f"((n1 + n0) * {p} * (1e0 - {p}))"
        steps.append(f"s{k} AS (SELECT t.entity, any_value(i.a) AS a, any_value(i.b) AS b, sum({d} * x) AS ga, sum({d}) AS gb, sum({w} * x * x) AS haa, sum({w} * x) AS hab, sum({w}) AS hbb FROM t JOIN i{k} i USING (entity) GROUP BY t.entity), "
                     f"i{k + 1} AS (SELECT entity, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{k})")
    return f""", d AS (SELECT entity, y_prob AS f, sum(y_true)::DOUBLE AS n1, sum(1 - y_true)::DOUBLE AS n0 FROM pred WHERE y_prob IS NOT NULL GROUP BY ALL),
 g AS (SELECT entity, avg(f) AS m, stddev_pop(f) AS sd, sum(n1) AS c1, sum(n0) AS c0 FROM d GROUP BY entity),
 t AS (SELECT d.*, (f - m) / sd AS x, (c1 + 1) / (c1 + 2) AS t1, 1e0 / (c0 + 2) AS t0 FROM d JOIN g USING (entity)), i0 AS (SELECT entity, 0e0 AS a, ln((c0 + 1) / (c1 + 1)) AS b FROM g), {", ".join(steps)},
 fin AS (SELECT entity, a / sd AS a, b - a * m / sd AS b FROM i{NEWTON} JOIN g USING (entity))
 SELECT fin.entity, any_value(fin.a) AS a, any_value(fin.b) AS b, avg(pow(1e0 / (1e0 + exp(fin.a * y_prob + fin.b)) - y_true, 2)) AS brier FROM pred JOIN fin ON pred.entity = fin.entity WHERE y_prob IS NOT NULL GROUP BY fin.entity"""


def _sigmoid(s: SparkSession, d: str) -> DataFrame:
    """The sigmoid of each scored entity, and the Brier score of its calibrated scores."""
    from plumbline.operators import calibration

    pred = predictions(s, d).where("y_prob is not null").cache()
    found = []
    for e in [r.entity for r in pred.select("entity").distinct().collect()]:
        scores = calibration.distinct_scores(pred.where(F.col("entity") == e).select(F.col("y_prob").alias("f"), F.col("y_true").alias("y"))).cache()
        found.append((e, *calibration.fit_sigmoid(scores)))
    fits = s.createDataFrame(found, "entity string, a double, b double")
    p = 1 / (1 + F.exp(F.col("a") * F.col("y_prob") + F.col("b")))
    return pred.join(F.broadcast(fits), "entity").groupBy("entity").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.avg(F.pow(p - F.col("y_true"), 2)).alias("brier"))


_register("sigmoid_calibration", _p(_sigmoid_sql()), "entity", doubles="a b brier")(_sigmoid)


def _windowed(s: SparkSession, d: str) -> DataFrame:
    from plumbline.streaming import counts

    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("entity"), (F.col("user_id") % 2).alias("y_true"), (F.col("event_id") % 2).alias("y_pred"))
    return counts.windowed(e, width="24 hours").withColumn("start", F.unix_seconds("start"))


_register("windowed_counts", "SELECT epoch(time_bucket(INTERVAL 24 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01')) AS start, event_type AS entity, count(*) FILTER (user_id % 2 = 1 AND event_id % 2 = 1) AS tp, count(*) FILTER (user_id % 2 = 0 AND event_id % 2 = 1) AS fp, count(*) FILTER (user_id % 2 = 0 AND event_id % 2 = 0) AS tn, count(*) FILTER (user_id % 2 = 1 AND event_id % 2 = 0) AS fn FROM events GROUP BY ALL", "entity", "start tp fp tn fn")(_windowed)


# reports over predictions, and intervals by hash-drawn replicates
_register("class_report", _p(f"""SELECT entity, r.label, r.p AS precision, r.c AS recall, r.f AS f1, r.s AS support FROM (SELECT entity, unnest([
 {{'label': '0', 'p': {METRICS['precision_0']}, 'c': {METRICS['recall_0']}, 'f': {METRICS['f1_0']}, 's': tn + fp}}, {{'label': '1', 'p': {METRICS['precision_1']}, 'c': {METRICS['recall_1']}, 'f': {METRICS['f1_1']}, 's': tp + fn}},
 {{'label': 'macro', 'p': ({METRICS['precision_0']} + {METRICS['precision_1']}) / 2e0, 'c': ({METRICS['recall_0']} + {METRICS['recall_1']}) / 2e0, 'f': ({METRICS['f1_0']} + {METRICS['f1_1']}) / 2e0, 's': tp + fp + tn + fn}},
 {{'label': 'weighted', 'p': ((tn + fp) * {METRICS['precision_0']} + (tp + fn) * {METRICS['precision_1']}) / (tp + fp + tn + fn), 'c': ((tn + fp) * {METRICS['recall_0']} + (tp + fn) * {METRICS['recall_1']}) / (tp + fp + tn + fn), 'f': {METRICS['f1_weighted']}, 's': tp + fp + tn + fn}}]) AS r FROM ({_counts('entity')}))"""), "entity label", "support", "precision recall f1")(lambda s, d: metrics.class_report(metrics.confusion(predictions(s, d), ["entity"]), ["entity"]))


def _two_thresholds(s: SparkSession, d: str) -> DataFrame:
    one = predictions(s, d).where("entity = 'A'")
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("e"), t.alias("t")) for n, t in (("default", F.lit(0.5)), ("own", F.col("threshold")))]))
    rows = one.select("y_true", "y_prob", both.alias("x")).select(F.col("x.e").alias("entity"), "y_true", (F.col("y_prob") >= F.col("x.t")).cast("int").alias("y_pred"))
    wide = metrics.confusion(rows, ["entity"]).select("entity", *[c.alias(n) for n, c in metrics.scores().items()])
    return metrics.default_against_own(metrics.long(wide, ["entity"], list(METRICS)))


_register("evaluate_thresholds", _p(f""", two AS (SELECT 'd' AS e, y_true, (y_prob >= 5e-1)::INT AS y_pred FROM pred WHERE entity = 'A' UNION ALL SELECT 'o', y_true, (y_prob >= threshold)::INT FROM pred WHERE entity = 'A'),
 w AS (SELECT e, {ALL} FROM ({_counts('e', 'two')})), l AS (UNPIVOT w ON {', '.join(METRICS)} INTO NAME metric VALUE value)
 SELECT metric, max(value) FILTER (e = 'd') AS at_default, max(value) FILTER (e = 'o') AS at_own, max(value) FILTER (e = 'o') - max(value) FILTER (e = 'd') AS difference FROM l GROUP BY metric"""), "metric", doubles="at_default at_own difference")(_two_thresholds)


def _auto(s: SparkSession, d: str) -> DataFrame:
    """Each dataset's and model's threshold, by the method that fits its number of rows."""
    pred = folded(s, d).where("y_prob is not null").withColumn("entity", F.concat_ws("|", "dataset", "entity"))
    n = pred.groupBy("entity").agg(F.count("*").alias("n"))
    both = metrics.youden(pred, ["entity"]).select("entity", F.col("threshold").alias("oof")).join(metrics.cv_threshold(pred), "entity").join(n, "entity")
    method = F.when(F.col("n") < 1000, "oof").otherwise("cv")
    return both.select("entity", method.alias("method"), F.when(method == "oof", F.col("oof")).otherwise(F.col("threshold")).alias("threshold"))


_register("auto_threshold", _p(f""", p2 AS (SELECT dataset || '|' || entity AS entity, fold, y_true, y_prob FROM pred WHERE y_prob IS NOT NULL),
 {_curve_sql('entity').replace('FROM pred WHERE y_prob IS NOT NULL', 'FROM p2')}, {_curve_sql('entity, fold').replace('FROM pred WHERE y_prob IS NOT NULL', 'FROM p2').replace('points', 'points2').replace('sums', 'sums2').replace('curve', 'curve2')},
 o AS (SELECT entity, y_prob AS t FROM curve QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(tpr - fpr, 12) DESC, y_prob DESC) = 1),
 c AS (SELECT entity, round(avg(y_prob), 12) AS t FROM (SELECT * FROM curve2 QUALIFY row_number() OVER (PARTITION BY entity, fold ORDER BY round(tpr - fpr, 12) DESC, y_prob DESC) = 1) GROUP BY entity),
 n AS (SELECT entity, count(*) AS n FROM p2 GROUP BY entity)
 SELECT entity, CASE WHEN n < 1000 THEN 'oof' ELSE 'cv' END AS method, CASE WHEN n < 1000 THEN o.t ELSE c.t END AS threshold FROM n JOIN o USING (entity) JOIN c USING (entity)"""), "entity method", doubles="threshold")(_auto)

SDRAWN = f"""{DRAWN}, got AS (SELECT entity, replicate, y_true, y_prob, {WEIGHT} AS w FROM (SELECT entity, replicate, y_true, y_prob, {HASH} AS h FROM rows, reps WHERE y_prob IS NOT NULL))"""
#: Each metric from what it needs alone.
SBOOT = {
    "auroc": f"""{SDRAWN}, runs AS (SELECT entity, replicate, y_prob, sum(w * y_true) AS p1, sum(w * (1 - y_true)) AS p0 FROM got GROUP BY ALL),
 upto AS (SELECT *, sum(p0) OVER (PARTITION BY entity, replicate ORDER BY y_prob) - p0 / 2e0 AS below FROM runs),
 boot AS (SELECT entity, replicate, sum(p1 * below) / (sum(p1) * sum(p0)) AS auroc FROM upto GROUP BY ALL HAVING sum(p1) > 0 AND sum(p0) > 0)""",
    "brier": f"{SDRAWN}, boot AS (SELECT entity, replicate, sum(w * (y_prob - y_true) * (y_prob - y_true)) / sum(w) AS brier FROM got GROUP BY ALL HAVING sum(w * y_true) > 0 AND sum(w * (1 - y_true)) > 0)",
    "ece": f"""{SDRAWN}, bins AS (SELECT entity, replicate, {BIN} AS bin, sum(w)::DOUBLE AS m, abs(sum(w * y_true) - sum(w * y_prob)) AS off, sum(w * y_true) AS p1, sum(w * (1 - y_true)) AS p0 FROM got GROUP BY ALL),
 boot AS (SELECT entity, replicate, sum(off) / sum(m) AS ece, max(off / nullif(m, 0)) AS mce FROM bins GROUP BY ALL HAVING sum(p1) > 0 AND sum(p0) > 0)""",
}
for _m, _name, _sql, _of in (("auroc", "bootstrap_auroc", "auroc", "auroc"), ("brier", "bootstrap_brier", "brier", "brier"), ("ece", "bootstrap_ece", "ece", "ece"), ("mce", "bootstrap_mce", "ece", "mce"), ("cliffs_delta", "cliffs_ci", "auroc", "2 * auroc - 1")):
    _register(_name, _p(f", {SBOOT[_sql]} SELECT entity, avg({_of}) AS mean, quantile_cont({_of}, 0.025) AS lower, quantile_cont({_of}, 0.975) AS upper FROM boot GROUP BY entity"), "entity", doubles="mean lower upper")(
        lambda s, d, m=_m: intervals.percentile_interval(replicates.score_replicates(predictions(s, d), REPLICATES), m)
    )
_register("formatted_ci", _p(f", {SBOOT['auroc']} SELECT entity, printf('%.3f [%.3f, %.3f]', avg(auroc), quantile_cont(auroc, 0.025), quantile_cont(auroc, 0.975)) AS text FROM boot GROUP BY entity"), "entity text")(
    lambda s, d: intervals.percentile_interval(replicates.score_replicates(predictions(s, d), REPLICATES), "auroc").select("entity", intervals.format_ci(F.col("mean"), F.col("lower"), F.col("upper")).alias("text"))
)
_register("forest_data", _p(f", {BOOT} SELECT entity, avg(mcc) AS point, quantile_cont(mcc, 0.025) AS lower, quantile_cont(mcc, 0.975) AS upper FROM boot GROUP BY entity"), "entity", doubles="point lower upper")(
    lambda s, d: intervals.forest(intervals.percentile_interval(replicates.count_replicates(predictions(s, d), REPLICATES), "mcc").select("entity", F.lit("mcc").alias("metric"), F.col("mean").alias("point"), "lower", "upper", F.lit(True).alias("valid")))
)


def _drawn(rows: str, keys: str, value: str, order: str, seed: str, b: int = REPLICATES) -> str:
    """SQL for transfer.bootstrap_means."""
    return f"""v AS (SELECT {keys}, {value} AS value, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS j, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows}),
 d AS (SELECT {keys}, replicate, ('0x' || substr(md5('{seed}:' || replicate || ':' || j), 1, 8))::BIGINT % n AS j FROM v, range({b}) t(replicate)),
 reps AS (SELECT {', '.join('d.' + k.strip() for k in keys.split(','))}, replicate, avg(v.value) AS mean FROM d JOIN v USING ({keys}, j) GROUP BY ALL)"""


GAPS = f"{CELLS}, per AS (SELECT model, metric, source, fold, max(value) FILTER (source = target) - avg(value) FILTER (source <> target) AS gap FROM fv GROUP BY ALL)"
_register("gap_ci", _p(f"{GAPS}, {_drawn('per', 'model, metric, source', 'gap', 'fold', 'gap')}, point AS (SELECT model, metric, source, avg(gap) AS mean, count(*) AS n FROM per GROUP BY ALL) SELECT model, metric, source, point.mean, quantile_cont(reps.mean, 0.025) AS lower, quantile_cont(reps.mean, 0.975) AS upper, n FROM reps JOIN point USING (model, metric, source) GROUP BY ALL"), "model metric source", "n", "mean lower upper")(
    lambda s, d: transfer.gap_interval(cell_values(s, d), REPLICATES)
)
_register("group_gap_ci", _p(f"{CELLS}, side AS (SELECT model, metric, CASE WHEN source = target THEN 'same' ELSE 'cross' END AS side, source, target, mean AS value FROM cell), {_drawn('side', 'model, metric, side', 'value', 'source, target', 'group')}, diff AS (SELECT model, metric, replicate, max(mean) FILTER (side = 'same') - max(mean) FILTER (side = 'cross') AS x FROM reps GROUP BY ALL), point AS (SELECT model, metric, avg(value) FILTER (side = 'same') - avg(value) FILTER (side = 'cross') AS gap FROM side GROUP BY ALL) SELECT model, metric, gap, quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper FROM diff JOIN point USING (model, metric) GROUP BY ALL"), "model metric", doubles="gap lower upper")(
    lambda s, d: transfer.group_gap_interval(cell_table(s, d), REPLICATES)
)
_register("fold_mean_ci", _p(f", {FOLD}, few AS (SELECT * FROM long WHERE metric IN ('mcc', 'f1_1')), {_drawn('few', 'entity, metric', 'value', 'fold', 'mean')}, point AS (SELECT entity, metric, avg(value) AS mean, count(*) AS n FROM few GROUP BY ALL) SELECT entity, metric, point.mean, quantile_cont(reps.mean, 0.025) AS lower, quantile_cont(reps.mean, 0.975) AS upper, n FROM reps JOIN point USING (entity, metric) GROUP BY ALL"), "entity metric", "n", "mean lower upper")(
    lambda s, d: transfer.mean_interval(fold_metrics(s, d).where("metric in ('mcc', 'f1_1')"), ["entity", "metric"], "value", ["fold"], REPLICATES)
)


def _history(s: SparkSession, d: str) -> DataFrame:
    """Folds of a search, from the folds of the entities: the better the mean, the lower the rank."""
    rows = fold_metrics(s, d).where("metric = 'mcc'")
    rank = rows.groupBy("entity").agg(F.avg("value").alias("_m")).select("entity", F.row_number().over(Window.orderBy(F.desc("_m"), "entity")).alias("rank"))
    return rows.join(rank, "entity").select("rank", F.col("entity").alias("parameters"), "fold", "value")


HIST = f", {FOLD}, one AS (SELECT entity AS parameters, fold, value FROM long WHERE metric = 'mcc'), hist AS (SELECT row_number() OVER (ORDER BY avg(value) DESC, parameters) AS rank, parameters, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS least, max(value) AS most FROM one GROUP BY parameters)"
_register("search_history", _p(f"{HIST} SELECT *, 100e0 * std / mean AS cv_pct, most - least AS spread FROM hist"), "parameters", "rank", "mean std cv_pct least most spread")(lambda s, d: transfer.search_summary(_history(s, d)))
_register("search_overview", _p(f"{HIST} SELECT count(*) AS candidates, max(mean) AS best, avg(mean) AS mean, stddev_pop(mean) AS std, min(mean) AS least, max(mean) AS most FROM hist"), "", "candidates", "best mean std least most")(lambda s, d: transfer.search_overview(_history(s, d)))


def _pairs_of_folds(s: SparkSession, d: str) -> DataFrame:
    one = lambda e: F.max(F.when(F.col("entity") == e, F.col("value")))
    return fold_metrics(s, d).where("entity in ('A', 'B')").groupBy("metric", "fold").agg(one("A").alias("baseline"), one("B").alias("ablated")).withColumn("name", F.col("metric")).withColumn("metric", F.lit("all"))


_register("top_ablations", _p(f"{ABL} SELECT name, b - a AS delta FROM q ORDER BY b - a DESC, name LIMIT 3"), "name", doubles="delta")(lambda s, d: transfer.top_ablations(transfer.ablation(_pairs_of_folds(s, d), ("metric", "name")), 3).select("name", "delta"))
#: Student's t of nine degrees of freedom (ten folds): a finite sum in the angle whose tangent is |t| / 3.
STUDENT9 = "1e0 - 2e0 / pi() * (o + sin(o) * (cos(o) + 2e0 / 3e0 * pow(cos(o), 3) + 8e0 / 15e0 * pow(cos(o), 5) + 16e0 / 35e0 * pow(cos(o), 7)))"
_register("ablation_tests", _p(f"""{ABL}, tt AS (SELECT 'all' AS metric, name, b AS baseline, a AS ablated, b - a AS delta, coalesce(100e0 * (b - a) / nullif(b, 0e0), 0e0) AS delta_pct, (b - a) / (sd / sqrt(n)) AS t, (b - a) / sqrt((sb * sb + sa * sa) / 2e0) AS d_av, n FROM q),
 pp AS (SELECT *, greatest({STUDENT9}, 0e0) AS p FROM (SELECT *, atan(abs(t) / 3e0) AS o FROM tt)),
 rr AS (SELECT *, least(1e0, (count(*) OVER () - row_number() OVER w + 1) * p) AS r FROM pp WINDOW w AS (ORDER BY p, name)), hh AS (SELECT *, max(r) OVER (ORDER BY p, name) AS p_holm FROM rr) SELECT *, p_holm < 5e-2 AS significant FROM hh"""), "metric name significant", "n", "baseline ablated delta delta_pct t d_av p p_holm")(lambda s, d: transfer.ablation_tests(_pairs_of_folds(s, d)))
_register("error_pairs", _p("SELECT entity, y_true, y_pred, count(*) AS n FROM pred WHERE y_prob IS NOT NULL AND y_true <> y_pred GROUP BY ALL"), "entity", "y_true y_pred n")(lambda s, d: errors.confusions(predictions(s, d)))
_register("confidence_summary", _p(f"{WRONG} SELECT entity, avg(confidence) AS mean, quantile_cont(confidence, 0.5) AS median, stddev_pop(confidence) AS std FROM wrong GROUP BY entity"), "entity", doubles="mean median std")(lambda s, d: errors.confidence_summary(predictions(s, d)))
_register("error_line", _p(f"{WRONG}{_cut_sql('entity, fold')} SELECT entity, avg(n) FILTER (cut = 9e-1) AS mean_confident, (SELECT count(*) FROM wrong w WHERE w.entity = bycut.entity) AS errors FROM bycut GROUP BY entity"), "entity", "errors", "mean_confident")(lambda s, d: errors.report_line(folded(s, d)))
_register("error_box", _p("SELECT entity, (y_true <> y_pred)::INT AS wrong, count(*) AS n, min(y_prob) AS least, quantile_cont(y_prob, 0.25) AS q25, quantile_cont(y_prob, 0.5) AS median, quantile_cont(y_prob, 0.75) AS q75, max(y_prob) AS most FROM pred WHERE y_prob IS NOT NULL GROUP BY ALL"), "entity", "wrong n", "least q25 median q75 most")(lambda s, d: errors.box(predictions(s, d), "y_prob"))
_register("delong_pairs", _p(f""", n AS (SELECT entity, sum(y_true)::DOUBLE AS n1, sum(1 - y_true)::DOUBLE AS n0 FROM pred WHERE y_prob IS NOT NULL GROUP BY entity),
 pts AS (SELECT entity, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM pred WHERE y_prob IS NOT NULL GROUP BY ALL), cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM pts WINDOW w AS (PARTITION BY entity ORDER BY y_prob)),
 pl AS (SELECT p.entity, p.sample_id, p.y_true, CASE WHEN p.y_true = 1 THEN (cn - neg / 2e0) / n0 ELSE 1 - (cp - pos / 2e0) / n1 END AS v FROM pred p JOIN cum USING (entity, y_prob) JOIN n USING (entity)),
 st AS (SELECT a.entity AS name_a, b.entity AS name_b, a.y_true, count(*) AS n, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) + var_samp(b.v) - 2 * covar_samp(a.v, b.v) AS s FROM pl a JOIN pl b ON a.sample_id = b.sample_id AND a.entity < b.entity GROUP BY ALL)
 SELECT name_a, name_b, max(ma) FILTER (y_true = 1) AS auroc_a, max(mb) FILTER (y_true = 1) AS auroc_b, sum(s / n) AS variance, (max(ma) FILTER (y_true = 1) - max(mb) FILTER (y_true = 1)) / sqrt(sum(s / n)) AS z, sum(n) AS n FROM st GROUP BY ALL"""), "name_a name_b", "n", "auroc_a auroc_b variance z")(lambda s, d: paired.delong_pairs(predictions(s, d)).drop("diff"))

# tables as they come: columns, support of rules, common features, verdict, ids
_register("columns_report", "SELECT * FROM (VALUES ('c_custkey', (SELECT count(*) FILTER (c_custkey IS NULL) FROM customer), (SELECT 100e0 * count(*) FILTER (c_custkey IS NULL) / count(*) FROM customer)), ('c_acctbal', (SELECT count(*) FILTER (c_acctbal IS NULL) FROM customer), (SELECT 100e0 * count(*) FILTER (c_acctbal IS NULL) / count(*) FROM customer))) t(\"column\", n_null, null_pct)", '"column"', "n_null", "null_pct")(lambda s, d: profile.columns_report(table(s, d, "customer").select("c_custkey", "c_acctbal")).drop("type"))
_register("rule_support", f"WITH {BASE} SELECT 'R1' AS rule, sum(R1) AS n, 100e0 * avg(R1) AS pct FROM base UNION ALL SELECT 'R2', sum(R2), 100e0 * avg(R2) FROM base UNION ALL SELECT 'R3', sum(R3), 100e0 * avg(R3) FROM base", "rule", "n", "pct")(lambda s, d: profile.support(base(s, d), RULES))
_register("common_features", "SELECT unnest(['l_orderkey', 'l_partkey']) AS name, unnest([1, 2]) AS place", "name", "place")(
    lambda s, d: s.createDataFrame([(c, i + 1) for i, c in enumerate(profile.common_features(table(s, d, "lineitem").columns, [["l_partkey", "l_tax", "l_orderkey"]], "l_tax"))], "name string, place int")
)
_register("validate_verdict", f"WITH {BASE} SELECT 'error' AS level, count(DISTINCT dataset) || ' classes, not 2' AS finding FROM base HAVING count(DISTINCT dataset) <> 2", "level finding")(lambda s, d: profile.verdict(base(s, d), "dataset"))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.experiments import numbered

    return numbered(table(s, d, "orders").select("o_orderstatus", "o_orderpriority")).groupBy("o_orderstatus", "o_orderpriority").agg(F.count_distinct("sample_id").alias("ids"))


_register("numbered_ids", "SELECT o_orderstatus, o_orderpriority, count(*) AS ids FROM orders GROUP BY ALL", "o_orderstatus o_orderpriority", "ids")(_numbered)
_register("length_by_type", f"WITH {BASE} SELECT dataset, count(*) AS n, avg(pa) AS mean, quantile_cont(pa, 0.5) AS median, stddev_samp(pa) AS std, min(pa) AS least, max(pa) AS most FROM base WHERE kind = 'F' GROUP BY dataset", "dataset", "n", "mean median std least most")(lambda s, d: profile.length_summary(base(s, d).where("kind = 'F'"), ["dataset"], "pa"))
_register("shapley_sampled", None)(_models(lambda m, s, rows: (lambda model: m.shapley_sampled(model, rows, FEATURES, 2).select("sample_id", "base", F.aggregate(F.map_values("phi"), F.lit(0.0), lambda a, x: a + x).alias("total"), "y_prob"))(m.fit(rows, FEATURES, "y", "logistic", regParam=0.001))))

# text files: the tables are written by Spark to the shared folder, with values that stand for missing ones, and read back
_HOLES = ("NA", "", "n/a", "NaN")


def _holed(column: str, key: str) -> F.Column:
    """The column as text, in which two fifths of the values stand for missing ones."""
    hole = F.element_at(F.array(*[F.lit(x) for x in _HOLES]), (F.col(key) % 10 + 1).cast("int"))
    return F.when(F.col(key) % 10 < len(_HOLES), hole).otherwise(F.col(column).cast("string"))


def _customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit(' "'), "c_name", F.lit('", ')).alias("c_name"), _holed("c_nationkey", "c_custkey").alias("c_nationkey"), _holed("c_acctbal", "c_custkey").alias("c_acctbal"), _holed("c_mktsegment", "c_custkey").alias("c_mktsegment"))


def _back(s: SparkSession, df: DataFrame, name: str, sep: str, **options) -> DataFrame:
    root = storage.shared_folder(s)
    files.write_csv(df, f"{root}/{name}", sep)
    return files.read(s, root, name, **options)


_FULL = "CASE WHEN c_custkey % 10 >= 4 THEN {c} END AS {c}"
_CUST = "SELECT c_custkey, ' \"' || c_name || '\", ' AS c_name, " + ", ".join(_FULL.format(c=c) for c in ("c_nationkey", "c_acctbal", "c_mktsegment")) + " FROM customer"
for _name, _file, _sep in (("scan_csv", "customers.csv", ","), ("scan_tsv", "customers.tsv", "\t"), ("scan_txt", "customers.txt", ";")):
    _register(_name, _CUST, "c_name c_mktsegment", "c_custkey c_nationkey", "c_acctbal")(lambda s, d, f=_file, sep=_sep: _back(s, _customers(s, d), f, sep))
_register("scan_csv_texts", "SELECT doc_id, sha256(text) AS digest, lang FROM documents WHERE text IS NOT NULL AND text <> ''", "digest lang", "doc_id")(
    lambda s, d: _back(s, table(s, d, "documents").select("doc_id", "text", "lang"), "documents.csv", ",", multiline=True).where("text is not null").select("doc_id", F.sha2(F.col("text").cast("string"), 256).alias("digest"), "lang")
)


def _either(s: SparkSession, d: str) -> DataFrame:
    """Lines that use a comma and a tab, in one file."""
    root = storage.shared_folder(s)
    lines = table(s, d, "customer").select(F.concat_ws(",", "c_custkey", "c_nationkey").alias("c_custkey,c_nationkey"), "c_mktsegment")
    files.write_csv(lines, f"{root}/mixed.txt", "\t")
    return files.read_mixed(s, f"{root}/mixed.txt")


_register("scan_mixed", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer", "c_mktsegment", "c_custkey c_nationkey")(_either)


def _several(s: SparkSession, d: str) -> DataFrame:
    """Three files with other columns each, pooled by a configuration; rows alike but for the id count once."""
    root, o = storage.shared_folder(s), table(s, d, "orders")
    files.write_csv(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), f"{root}/first.csv")
    files.write_csv(o.select("o_orderstatus", "o_custkey", "o_orderkey"), f"{root}/second.tsv", "\t")
    o.select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(f"{root}/third.parquet")
    names = ["o_orderstatus", "o_orderpriority"]
    configs = [{"filename": "first.csv", "name": "first", "subset_cols": names, "id_column": "o_orderkey"}, {"filename": "second.tsv", "name": "second", "drop_duplicates": False}, {"filename": "third.parquet", "name": "third"}]
    return files.read_many(s, root, configs).groupBy("dataset", "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"), F.sum(F.round("o_totalprice", 2).cast("decimal(20,2)")).cast("double").alias("price"))


_register("read_pool", """SELECT 'first' AS dataset, o_orderstatus, o_orderpriority, count(*) AS n, NULL AS customers, NULL AS price FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) GROUP BY ALL
 UNION ALL SELECT 'second', o_orderstatus, NULL, count(*), sum(o_custkey), NULL FROM orders GROUP BY ALL
 UNION ALL SELECT 'third', o_orderstatus, NULL, count(*), NULL, sum(o_totalprice::DECIMAL(20,2))::DOUBLE FROM orders GROUP BY ALL""", "dataset o_orderstatus o_orderpriority", "n customers", "price")(_several)
_register("numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part", "", "p_partkey p_size", "p_retailprice")(lambda s, d: clean.numeric(table(s, d, "part")))
_register("subset_columns", "SELECT p_size, p_brand, p_partkey FROM part", "p_brand", "p_size p_partkey")(lambda s, d: clean.subset(table(s, d, "part"), ["p_size", "p_brand", "p_partkey"]))


# the store of folds, and the tables of a run
def _stored(s: SparkSession, d: str) -> tuple[files.PredictionStore, str]:
    """All predictions with scores, put into a new store; one fold of B is left without its marker, as by a run that ended."""
    pred = folded(s, d).where("y_prob is not null").select(F.lit("all").alias("dataset"), "entity", "fold", "sample_id", "y_true", "y_prob", "threshold", "y_pred")
    store = files.PredictionStore(s, storage.shared_folder(s))
    key = files.run_key({"seed": 42}, table(s, d, "orders"))
    store.put(pred.where("entity = 'A' or fold < 9"), key)
    store._write(pred.where("entity = 'B' and fold = 9"), key)
    return store, key


_register("store_rows", _p("SELECT entity, fold, sample_id, y_true, y_pred, y_prob, threshold FROM pred WHERE y_prob IS NOT NULL AND (entity = 'A' OR fold < 9)"), "entity", "fold sample_id y_true y_pred", "y_prob threshold")(lambda s, d: (lambda store, key: store.get(key).drop("dataset", "run_key"))(*_stored(s, d)))
_register("store_summary", _p("SELECT 'all' AS dataset, entity, string_agg(DISTINCT fold::VARCHAR, ',' ORDER BY fold::VARCHAR) AS folds, count(*) AS n FROM pred WHERE y_prob IS NOT NULL AND (entity = 'A' OR fold < 9) GROUP BY entity"), "dataset entity folds", "n")(
    lambda s, d: _stored(s, d)[0].summary().select("dataset", "entity", F.concat_ws(",", "folds").alias("folds"), "n")
)
_EVERY = f"""{{mid}}, au AS ({{auc}}), br AS (SELECT {{k}}, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM pred WHERE y_prob IS NOT NULL GROUP BY ALL),
 eb AS (SELECT {{k}}, {BIN} AS bin, count(*) AS n, abs(avg(y_prob) - avg(y_true)) AS off FROM pred WHERE y_prob BETWEEN 0e0 AND 1e0 GROUP BY ALL), ec AS (SELECT {{k}}, sum(n * off) / sum(n) AS ece, max(off) AS mce FROM eb GROUP BY ALL)
 SELECT * FROM (SELECT {{k}}, {ALL} FROM ({{counts}})) LEFT JOIN au USING ({{k}}) LEFT JOIN br USING ({{k}}) LEFT JOIN ec USING ({{k}})"""
for _name, _keys in (("metrics_all", "entity"), ("metrics_by_fold", "entity, fold")):
    _register(_name, _p(", " + _EVERY.format(k=_keys, mid=MID.format(k=_keys), auc=AUC.format(k=_keys), counts=_counts(_keys))), "entity", "fold" if "fold" in _keys else "", f"{NAMES} auroc brier ece mce")(
        lambda s, d, k=_keys.split(", "): metrics.all_metrics(folded(s, d) if "fold" in k else predictions(s, d), k)
    )


def _rule_intervals(s: SparkSession, d: str) -> DataFrame:
    called = rules.predictions(base(s, d), RULES, rules.defaults(RULES), ["sample_id", "y_true"])
    reps = replicates.count_replicates(called, REPLICATES)
    bounds = metrics.long(reps, ["entity", "replicate"], ["precision_1", "recall_1", "mcc"]).groupBy("entity", "metric")
    ends = bounds.agg(F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return ends.select("entity", rules.kind(F.col("entity")).alias("kind"), "metric", "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


_register("rule_intervals", f"WITH {BASE}, {_rules_sql(RULES + rules.defaults(RULES))}, {BOOT.replace('FROM pred)', 'FROM called)')}, l AS (SELECT entity, unnest(['precision_1', 'recall_1', 'mcc']) AS metric, unnest([precision_1, recall_1, mcc]) AS value FROM boot) SELECT entity, CASE WHEN contains(entity, ' AND ') OR contains(entity, ' OR ') THEN 'combination' ELSE 'individual' END AS kind, metric, avg(value) AS mean, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM l GROUP BY ALL", "entity kind metric", doubles="mean lower upper")(_rule_intervals)


# outputs: predictions in both layouts, by way of a file; p values as text; manifest
def _predicted(s: SparkSession, d: str, proba: bool) -> DataFrame:
    from plumbline.plans.experiments import laid_out

    scored = base(s, d).select("sample_id", F.col("pa").alias("y_prob"))
    return _back(s, laid_out(scored, 0.45, ["sample_id"], proba), "predictions.csv", ",")


_register("predict_labels", f"WITH {BASE} SELECT sample_id, (pa >= 45e-2)::INT AS prediction FROM base", "", "sample_id prediction")(lambda s, d: _predicted(s, d, False))
_register("predict_scores", f"WITH {BASE} SELECT sample_id, 1e0 - pa AS prob_class_0, pa AS prob_class_1, (pa >= 45e-2)::INT AS predicted_class, 45e-2 AS optimal_threshold, pa - 45e-2 AS prob_diff_to_threshold FROM base", "", "sample_id predicted_class", "prob_class_0 prob_class_1 optimal_threshold prob_diff_to_threshold")(lambda s, d: _predicted(s, d, True))
_register("formatted_p", _p(f", {TESTS_SQL} SELECT family, name, CASE WHEN p < 1e-3 THEN '<0.001' ELSE printf('%.3f', p) END AS text FROM tests"), "family name text")(lambda s, d: kind_tests(s, d).select("family", "name", intervals.format_p(F.col("p")).alias("text")))


def _listed_files(s: SparkSession, d: str) -> DataFrame:
    """The manifest of a folder with a file of order numbers, in order, for each priority."""
    root = storage.shared_folder(s)
    lines = table(s, d, "orders").select("o_orderpriority", F.col("o_orderkey").cast("string").alias("value"))
    lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(f"{root}/orders")
    found = files.manifest(s, f"{root}/orders").where("not endswith(path, '/_SUCCESS')")
    name = F.regexp_extract(F.expr("url_decode(url_decode(path))"), "o_orderpriority=([^/]*)/", 1)
    return found.select(name.alias("name"), F.regexp_extract("path", "[.]([a-z]+)$", 1).alias("ending"), "bytes", "sha256")


_register("manifest_files", "SELECT o_orderpriority AS name, 'txt' AS ending, sum(length(o_orderkey::VARCHAR) + 1) AS bytes, sha256(string_agg(o_orderkey || chr(10), '' ORDER BY o_orderkey::VARCHAR)) AS sha256 FROM orders GROUP BY o_orderpriority", "name ending sha256", "bytes")(_listed_files)
