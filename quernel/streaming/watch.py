"""Watching a note folder: a streaming query whose ticks refresh the index.

Spark's file source reports a path once, so a note that is edited in place or
deleted wouldn't come through it.  Ticks come from the rate source; each scans
the folder and compares it with the manifest, which finds every change, and
ticks that pile up during a refresh become one.
"""

from __future__ import annotations

import logging
import os
import signal
from collections.abc import Callable
from pathlib import Path

from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.engine import Engine
from ..plans.index import Stats

log = logging.getLogger(__name__)


def watch(engine: Engine, checkpoint: str, every: str = "2 seconds", report: Callable[[Stats], None] | None = None) -> StreamingQuery:
    """Refreshes once, then at every tick; a refresh that fails is logged and the next one tries again."""

    def tick(*_) -> None:
        try:
            stats = engine.refresh()
            if report and (stats.indexed or stats.deleted):
                report(stats)
        except Exception:
            log.exception("refresh failed")

    tick()
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def _pid_file(config: Config) -> Path:
    return Path(config.root) / config.index.data_dir / "watch.pid"


def running(config: Config) -> int | None:
    """The process that watches the folder, if one does; what a dead one left is removed."""
    file = _pid_file(config)
    try:
        pid = int(file.read_text())
        os.kill(pid, 0)
        return pid
    except PermissionError:
        return pid
    except (OSError, ValueError):
        file.unlink(missing_ok=True)
        return None


def stop(config: Config) -> bool:
    """Asks the watching process to end; whether there is one."""
    pid = running(config)
    if pid:
        os.kill(pid, signal.SIGTERM)
    return pid is not None


def run(engine: Engine, every: str = "2 seconds", report: Callable[[Stats], None] | None = None) -> None:
    """Watches until the process is told to stop; one process a folder."""
    if pid := running(engine.config):
        raise RuntimeError(f"process {pid} watches this folder already")
    file = _pid_file(engine.config)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(str(os.getpid()))
    query = watch(engine, f"{engine.store.path}/watch", every, report)
    before = signal.signal(signal.SIGTERM, lambda *_: query.stop())
    try:
        while query.isActive:
            query.awaitTermination(1)
    finally:
        signal.signal(signal.SIGTERM, before)
        file.unlink(missing_ok=True)
