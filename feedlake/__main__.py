"""``python -m feedlake sequencer|gc|rebuild MODULE:FUNCTION [--once]``; the function makes a Store from a SparkSession."""

from __future__ import annotations

import importlib
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .plans import admin
from .streaming.feed import run_sequencer


def main(arguments: list[str]) -> int:
    if len(arguments) < 2 or arguments[0] not in ("sequencer", "gc", "rebuild"):
        print(__doc__, file=sys.stderr)
        return 2
    module, _, function = arguments[1].partition(":")
    store = getattr(importlib.import_module(module), function)(SparkSession.builder.getOrCreate())
    once = "--once" in arguments
    if arguments[0] == "rebuild":
        print("files and partitions added:", *admin.rebuild(store))
    elif arguments[0] == "sequencer":
        store.drain() if once else run_sequencer(store)
    else:
        while True:
            now = datetime.now(UTC)
            print("reclaimed:", admin.collect_garbage(store, now), "swept:", admin.sweep(store, now))
            if once:
                break
            time.sleep(3600)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
