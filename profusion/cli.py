"""Command line: ``python -m profusion.cli --inputs DIR [--config FILE] [--output FILE | --parts DIR]``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from profusion.plans.pipeline import read_config, run, write_json, write_json_parts

log = logging.getLogger("profusion")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Resolve the person records in a folder into profiles.")
    parser.add_argument("--inputs", required=True)
    parser.add_argument("--config")
    parser.add_argument("--output", help="a file of this machine; without it and --parts, standard output")
    parser.add_argument("--parts", help="a folder, of any store, for the array in parts")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("profusion").getOrCreate()
    try:
        profiles = run(spark, args.inputs, read_config(args.config))
        if args.parts:
            write_json_parts(profiles, args.parts)
        else:
            write_json(profiles, args.output)
    except Exception:  # noqa: BLE001  the command line reports any failure by its exit status
        log.exception("the run failed")
        return 1
    log.info("wrote %s", args.parts or args.output or "standard output")
    return 0


if __name__ == "__main__":
    sys.exit(main())
