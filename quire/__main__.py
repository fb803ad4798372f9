"""python -m quire run SOURCE FOLDER [--config FILE] [--only STAGE] [--until STAGE] [--force] [--compression X] | version"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="condense the books of a folder")
    r.add_argument("source")
    r.add_argument("folder")
    r.add_argument("--config")
    r.add_argument("--only")
    r.add_argument("--until")
    r.add_argument("--force", action="store_true")
    r.add_argument("--compression", type=float)
    r.add_argument("--export")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        print("quire 0.1.0")
        return 0
    from quire.plans import config, pipeline
    from quire.session import get_session, ship

    try:
        settings = config.load(a.config, {"distill": {"compression_ratio": a.compression}} if a.compression else None)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    spark = get_session("*", "quire")
    ship(spark)
    done = pipeline.run_pipeline(spark, a.source, a.folder, settings, a.only, a.force, a.until)
    for name, how in done.done:
        print(f"{name}: {how}")
    if a.export:
        pipeline.export(done, a.export)
    return 0


if __name__ == "__main__":
    sys.exit(main())
