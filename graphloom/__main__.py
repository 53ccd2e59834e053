"""python -m graphloom --root DIR [--resources DIR] [--stages load,chunk] [--config FILE] [--dry-run]: the offline run."""

from __future__ import annotations

import argparse
import json
import logging
import os


def main(argv: list[str] | None = None) -> dict[str, int]:
    from .config import EngineConfig
    from .pipeline import STAGES, Pipeline
    from .sources.catalog import Catalog

    a = argparse.ArgumentParser(prog="graphloom", description="Build the knowledge graph of a folder of texts.")
    a.add_argument("--root", required=True, help="folder of the tables")
    a.add_argument("--resources", help="folder of the files to load")
    a.add_argument("--config", help="JSON settings")
    a.add_argument("--stages", default=",".join(STAGES), help="comma-joined, in this order: " + ",".join(STAGES))
    a.add_argument("--dry-run", action="store_true", help="count what would be done and write nothing")
    a.add_argument("--log", default="WARNING")
    x = a.parse_args(argv)
    stages = tuple(s for s in x.stages.split(",") if s)
    if unknown := set(stages) - set(STAGES):
        a.error(f"no such stages: {', '.join(sorted(unknown))}")
    logging.basicConfig(level=x.log.upper())
    from pyspark.sql import SparkSession

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH", "")]))
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    config = EngineConfig.load(x.config) if x.config else EngineConfig()
    if x.resources:
        config = config.merged({"resources_dir": x.resources})
    done = Pipeline(Catalog(spark, x.root, read_only=x.dry_run), config).run(tuple(s for s in STAGES if s in stages), x.dry_run)
    print(json.dumps(done))
    return done


if __name__ == "__main__":
    main()
