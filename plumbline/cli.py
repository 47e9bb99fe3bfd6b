"""Command line: python -m plumbline.cli COMMAND ...

Exit codes: 0 done, 1 failed, 2 bad input or settings, 130 interrupted, 143 terminated.
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
from pathlib import Path

from plumbline.settings import Settings

FAILED, INVALID, INTERRUPTED, TERMINATED = 1, 2, 130, 143


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, data: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        if data:
            c.add_argument("data", nargs="+" if name == "cross-dataset" else None, help="table(s): csv, tsv, txt, parquet, json")
            c.add_argument("--config", help="JSON settings")
            c.add_argument("--target")
            c.add_argument("--id-column")
        return c

    for name, about in (("compare-models", "models and rules against each other"), ("cross-dataset", "each dataset's model on every dataset"), ("train", "fit and save one model"), ("ablation", "AUROC without features or groups")):
        c = command(name, about)
        c.add_argument("--out", required=True)
        c.add_argument("--features", help="a,b,c or a .txt file")
        c.add_argument("--models", help="names, by comma")
        c.add_argument("--param-config", dest="grids", help="JSON: model to parameter to list of values, searched in place of its own grid")
        c.add_argument("--missing")
        c.add_argument("--outer", type=int)
        c.add_argument("--inner", type=int)
        c.add_argument("--seed", type=int)
        c.add_argument("--search", action="store_true", default=None, help="choose parameters from the whole grid, inside each fold")
        c.add_argument("--search-budget", type=int, help="so many trials of the grid, proposed by those before")
        c.add_argument("--search-seconds", type=float, help="begin no trial after so many seconds")
        c.add_argument("--calibrate", action="store_true", default=None)
        c.add_argument("--calibration-folds", type=int)
        c.add_argument("--calibration", help="isotonic or sigmoid")
        c.add_argument("--level", type=float)
        c.add_argument("--keep-duplicates", action="store_true")
        c.add_argument("--dry-run", action="store_true", help="check settings and columns only")
        if name == "compare-models":
            c.add_argument("--rules", help="0/1 columns, by comma")
            c.add_argument("--combination", dest="combinations", action="append", help='"A AND B"; may be repeated')
            c.add_argument("--correction")
            c.add_argument("--bootstrap", type=int)
            c.add_argument("--explain", action="store_true", default=None, help="the share of each feature in each score, kept beside the predictions")
        if name == "ablation":
            c.add_argument("--feature-groups", help="JSON or YAML: group to columns")
            c.add_argument("--metric", dest="metrics", action="append", help="a metric to measure by; may be repeated")
            c.add_argument("--steps", action="store_true", help="also without scaling, calibration and threshold")
    for name, about in (("predict", "score rows by a saved model"), ("evaluate", "metrics of a saved model on labelled rows")):
        c = command(name, about)
        c.add_argument("--model", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--default-threshold", action="store_true")
        if name == "predict":
            c.add_argument("--proba", action="store_true", help="probabilities and threshold, not the prediction alone")
    command("validate", "check a table and its target")
    command("list-models", "names of models and sizes of their grids", data=False)
    command("smoke-test", "a small run on rows made here", data=False)
    command("version", "versions", data=False)
    return p


def _settings(a: argparse.Namespace) -> Settings:
    """The file's settings with those of the command line in their place."""
    from plumbline.sources.files import listed

    s = Settings.load(a.config) if getattr(a, "config", None) else Settings()
    given = {k: v for k, v in vars(a).items() if k in vars(s)}
    given |= {k: listed(given[k]) for k in ("features", "models", "rules") if given.get(k)}
    given |= {"grids": json.loads(Path(given["grids"]).read_text())} if given.get("grids") else {}
    s = s.merged(**given)
    if bad := s.problems():
        raise ValueError("; ".join(bad))
    return s


def _read(spark, path: str, a: argparse.Namespace, distinct: bool):
    from plumbline.sources import files

    root, name = os.path.split(path)
    return files.read(spark, root or ".", name, id_column=a.id_column, distinct=distinct)


def _save(title: str, tables: dict, out: str, s: Settings | None = None) -> None:
    """Each table to its folder of Parquet and, small as they are, a page and a text of all; with settings, also what the run
    ran on and with."""
    from plumbline import report
    from plumbline.sources import files

    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    stored = {name: df.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}") for name, df in tables.items()}
    if "://" not in out:
        Path(out, "report.html").write_text(report.page(title, stored))
        lines = {"pairwise": report.comparison_line, "ablation": report.ablation_line, "steps": report.ablation_line}
        words = [line(r) for name, line in lines.items() if name in stored for r in stored[name].limit(report.SHOWN).collect()]
        Path(out, "report.txt").write_text(report.text(title, stored) + "".join(f"\n{w}" for w in ["", *words]))
        spark = next(iter(tables.values())).sparkSession
        if s is not None:
            from plumbline.operators.models import fold_seeds
            from plumbline.sources.artifacts import environment

            Path(out, "run.json").write_text(json.dumps({"settings": vars(s), "environment": environment(spark, fold_seeds(s.seed, s.outer))}, indent=1, default=str))
        rows = [r.asDict() for r in files.manifest(spark, out).collect()]
        Path(out, "manifest.json").write_text(json.dumps(rows, indent=1, default=str))


def run(a: argparse.Namespace, spark=None) -> int:
    from plumbline.operators import models, profile

    if a.command == "list-models":
        print("\n".join(f"{n}\t{len(grid)}" for n, (_, grid) in models.REGISTRY.items()))
        return 0
    if a.command == "version":
        from plumbline.sources.artifacts import versions

        print(" ".join(f"{k} {v}" for k, v in versions().items()))
        return 0
    from pyspark.sql import SparkSession

    from plumbline.plans import experiments

    spark = spark or SparkSession.builder.appName(f"plumbline {a.command}").getOrCreate()
    if a.command == "smoke-test":
        rows = spark.range(300).selectExpr("id as sample_id", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b").selectExpr("*", "cast(a + 0.3D * b > 0.65D as int) as state")
        oof = models.out_of_fold(rows, ["a", "b"], "state", "logistic", 2, regParam=0.001)
        print("ok" if oof.count() == 300 else "failed")
        return 0
    s = _settings(a)
    if a.command in ("predict", "evaluate"):
        df, t = _read(spark, a.data, a, False), 0.5 if a.default_threshold else None
        if a.command == "predict":
            experiments.predict(df, a.model, a.id_column, t, a.proba).write.mode("overwrite").csv(a.out, header=True)
        else:
            _save("Evaluation", experiments.evaluate(df, a.model, t), a.out)
        return 0
    if a.command == "cross-dataset":
        from plumbline.operators.clean import pooled

        df = pooled([(_read(spark, d, a, not a.keep_duplicates), Path(d).stem) for d in a.data])
    else:
        df = _read(spark, a.data, a, a.command != "validate" and not a.keep_duplicates)
    if a.command == "validate":
        if s.target not in df.columns:
            raise ValueError(f"no column {s.target!r}")
        classes = profile.balance(df, [], s.target).collect()
        print("\n".join(f"{r.y}\t{r.n}\t{r.share:.4f}" for r in classes))
        if len(classes) != 2:
            raise ValueError(f"{len(classes)} classes in {s.target!r}, not 2")
        if min(r.n for r in classes) < 10:
            print("warning: fewer than 10 rows of a class", file=sys.stderr)
        return 0
    rows, features = experiments.prepared(df, s)
    if a.dry_run:
        print(f"{a.command}: {len(features)} features, models {', '.join(s.models)}, {s.outer} x {s.inner} folds")
        return 0
    if a.command == "compare-models":
        _save("Comparison of models", experiments.compare(df, s, a.out), a.out, s)
    elif a.command == "cross-dataset":
        _save("Across datasets", experiments.cross(df, s), a.out, s)
    elif a.command == "train":
        print(f"threshold {experiments.train(df, s, s.models[0], a.out)['threshold']:.6f}")
    else:
        from plumbline.sources.files import groups

        _save("Ablation", experiments.ablation(df, s, s.models[0], groups(a.feature_groups) if a.feature_groups else None, a.steps), a.out, s)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    def ended(*_) -> None:
        raise SystemExit(TERMINATED)

    try:
        before = signal.signal(signal.SIGTERM, ended)
    except ValueError:  # not in the main thread
        before = None
    try:
        return run(_parser().parse_args(argv), spark)
    except KeyboardInterrupt:
        return INTERRUPTED
    except (ValueError, KeyError, FileNotFoundError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return INVALID
    except Exception as e:  # the last resort of a command line
        print(f"failed: {e}", file=sys.stderr)
        return FAILED
    finally:
        if before is not None:
            signal.signal(signal.SIGTERM, before)


if __name__ == "__main__":
    sys.exit(main())
