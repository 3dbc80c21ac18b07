"""``python -m tidelog pipeline.yaml --source FOLDER --target FOLDER``.

Exit code 0: done; 1: the run failed; 2: wrong use.
"""

from __future__ import annotations

import argparse
import logging
import signal
import sys
from pathlib import Path

from .log import set_up
from .plans.config import parse_pipeline
from .plans.selector import ConfigError


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", exit_on_error=False)
    parser.add_argument("pipeline", help="YAML settings")
    parser.add_argument("--source", default="", help="folder of <database>/<table>.parquet and .changes; JDBC by the settings without it")
    parser.add_argument("--target", default="", help="folder of versioned tables, in place of the sink's server")
    parser.add_argument("--follow", action="store_true", help="go on with changes as they arrive, until stopped")
    parser.add_argument("--available", action="store_true", help="with --follow: end with what is there now")
    parser.add_argument("--check", action="store_true", help="only read the settings")
    try:
        args = parser.parse_args(arguments)
    except (argparse.ArgumentError, SystemExit) as e:
        return 0 if isinstance(e, SystemExit) and e.code in (0, None) else 2
    try:
        pipeline = parse_pipeline(Path(args.pipeline).read_text())
    except (OSError, ConfigError) as e:
        print(e, file=sys.stderr)
        return 1
    set_up(pipeline.logging)
    if args.check:
        return 0
    from pyspark.sql import SparkSession

    from .plans.job import Job
    from .sources.tables import FolderSource, JdbcSource

    spark = SparkSession.builder.appName(pipeline.runtime.name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.source:
            source = FolderSource.open(spark, args.source)
        else:
            s = pipeline.source
            source = JdbcSource(spark, f"jdbc:mysql://{s.hostname}:{s.port}/", {"user": s.username, "password": s.password} | s.jdbc_properties, pipeline.runtime.parallelism)
        job = Job(spark, pipeline, source, args.target)
        if args.follow:
            interval = None if args.available else f"{pipeline.checkpoint.interval} seconds"
            query = job.follow(f"{pipeline.checkpoint.file_path}.stream", interval)
            signal.signal(signal.SIGTERM, lambda *_: query.stop())
            try:
                query.awaitTermination()
            except KeyboardInterrupt:
                query.stop()
            logging.getLogger("tidelog").info("stopped: %s", job.stats.report())
        else:
            for name, position in job.run().items():
                logging.getLogger("tidelog").info("%s: up to %s", name, position)
    except Exception:
        logging.getLogger("tidelog").exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
