"""Trust analytics for binary classifiers on Spark.  The names below are found here too; each module is loaded at its first use."""

from importlib import import_module

_WHERE = {
    "plumbline.operators.metrics": "all_metrics auroc brier calibration_error class_report confusion curve reliability summary youden",
    "plumbline.operators.replicates": "count_replicates intervals metric_values register_metric score_replicates",
    "plumbline.operators.intervals": "all_intervals cliffs_delta count_intervals format_ci format_p score_intervals",
    "plumbline.operators.paired": "benjamini_hochberg compare delong_pairs holm pairs",
    "plumbline.operators.rules": "defaults parse",
    "plumbline.operators.folds": "holdout stratified",
    "plumbline.operators.models": "Plan cross fit fit_calibrated held_out_datasets leave_out out_of_fold register search step_ablation",
    "plumbline.operators.explain": "explain mean_shares",
    "plumbline.operators.metric_tree": "nearest",
    "plumbline.operators.shift": "ks proportion",
    "plumbline.operators.transfer": "ablation_tests cells gap_interval",
    "plumbline.settings": "Settings",
    "plumbline.sources.files": "PredictionStore read read_many",
}
_NAMES = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_NAMES[name]), name)


def __dir__() -> list[str]:
    return [*globals(), *__all__]
