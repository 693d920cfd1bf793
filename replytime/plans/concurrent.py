"""Run independent fits side by side: Spark schedules jobs submitted from
several driver threads concurrently, so small iterative fits (each a chain of
one-aggregate jobs) overlap instead of queueing."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor


def run_all(tasks, max_workers: int = 4):
    """Call every zero-argument callable, concurrently; results in input order."""
    tasks = list(tasks)
    if len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(tasks))) as pool:
        return list(pool.map(lambda t: t(), tasks))
