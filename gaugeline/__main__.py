"""``python -m gaugeline``: run a task from a JSON configuration, or a named query on a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys

from .session import session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gaugeline", description=__doc__)
    steps = out.add_subparsers(dest="step", required=True)
    run = steps.add_parser("run", help="run a task")
    run.add_argument("task", help="anomaly_qc, profile_reconstruction or wave_forecast")
    run.add_argument("config", help="a JSON file: dataset, feature, model, validation, experiments, report")
    run.add_argument("--out", help="where the result goes, as Parquet")
    query = steps.add_parser("query", help="run a query of the catalogue")
    query.add_argument("name")
    query.add_argument("folder", help="a folder with a Parquet file per table")
    query.add_argument("--out", help="where the result goes, as Parquet; else it is shown")
    steps.add_parser("list", help="the tasks and queries there are")
    return out


def main(words: list[str] | None = None) -> int:
    given = parser().parse_args(words)
    from .plans import catalog, tasks

    if given.step == "list":
        print("\n".join(["tasks:", *sorted(tasks.TASKS), "", "queries:", *sorted(catalog.QUERIES)]))
        return 0
    spark = session()
    if given.step == "run":
        task = tasks.create(given.task, spark, json.loads(spark.read.text(given.config, wholetext=True).first()["value"]))
        out = task.run()
        print(json.dumps(task.metrics))
    else:
        out = catalog.QUERIES[given.name](spark, given.folder)
    if given.out:
        out.write.mode("overwrite").parquet(given.out)
    else:
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
