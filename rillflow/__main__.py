"""python -m rillflow --config pipeline.yaml"""

from __future__ import annotations

import argparse

from rillflow.session import session
from rillflow.streaming.pipeline import Config, Pipeline


def main() -> None:
    p = argparse.ArgumentParser(prog="rillflow")
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--once", action="store_true", help="stop when the sources have nothing more")
    a = p.parse_args()
    pipeline = Pipeline(session(), Config.read(a.config))
    try:
        pipeline.run(a.once)
    except KeyboardInterrupt:
        pipeline.stop()


if __name__ == "__main__":
    main()
