"""Run records as CSV, human log lines, and readable sizes and times."""

from __future__ import annotations

import csv
import logging
import os

COMPILE_COLUMNS = ("exp_id", "graph", "pattern", "adjacency", "size", "query_type", "scheduler", "pruning_type", "parallel_type", "plan_seconds", "compile_seconds")
RUN_COLUMNS = ("exp_id", "graph", "pattern", "query_type", "scheduler", "pruning_type", "parallel_type", "threads", "run_seconds", "matches", "matches_per_second", "allocated")
LEVELS = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "WARN": 30, "ERROR": 40, "FATAL": 50}


def append(path: str, columns: tuple[str, ...], row: dict) -> None:
    """Adds a row, with a header if the file is new."""
    fresh = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="") as f:
        out = csv.DictWriter(f, columns)
        if fresh:
            out.writeheader()
        out.writerow({c: row.get(c, "") for c in columns})


def run_time(seconds: float, finished: bool = True) -> str:
    return f"{seconds:.6f}" + ("" if finished else " (Time Out)")


def logger(name: str = "graphloom") -> logging.Logger:
    """Level by GRAPHLOOM_LOG_LEVEL, times hidden by GRAPHLOOM_LOG_HIDE_TIME."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        hide = os.environ.get("GRAPHLOOM_LOG_HIDE_TIME", "") not in ("", "0")
        handler.setFormatter(logging.Formatter("%(levelname)s %(message)s" if hide else "%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(LEVELS.get(os.environ.get("GRAPHLOOM_LOG_LEVEL", "INFO").upper(), 20))
    return log


def _scaled(value: float, steps: list[tuple[float, str]]) -> str:
    unit = steps[0][1]
    for factor, name in steps[1:]:
        if value < factor:
            break
        value, unit = value / factor, name
    return f"{value:.3g} {unit}"


def readable_size(size: float) -> str:
    return _scaled(size, [(1, "B"), (1024, "KB"), (1024, "MB"), (1024, "GB"), (1024, "TB")])


def readable_time(seconds: float) -> str:
    return _scaled(seconds, [(1, "s"), (60, "min"), (60, "h")])
