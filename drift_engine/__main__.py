"""python -m drift_engine --config FILE"""

from __future__ import annotations

import argparse

from drift_engine import session
from drift_engine.plans import config, workflow


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="drift_engine", description="Transition matrices, ridges and fronts of trajectories.")
    parser.add_argument("--config", required=True, help="YAML file with the run's settings")
    cfg = config.load(parser.parse_args(arguments).config)
    print(workflow.run(session.build(), cfg))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
