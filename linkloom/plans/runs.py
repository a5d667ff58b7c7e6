"""What a run measured, read from Spark's own records of stages and tasks.

Iterations of one block are one plan, so a block is the finest thing that has
times: its iterations share its wall and compute time, shuffled bytes and waits
evenly, and all show its tasks. Stages belong to the block in which they ended; the first block
also holds what prepares the run. Other jobs of the same application at that time count too.
"""

from __future__ import annotations

import json
import resource
import time
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..operators.pagerank import Ranks

#: Names of fields of the metrics files: fixed values.
TASK_FIELDS = ("task_min_s", "task_max_s", "task_avg_s", "task_std_s", "load_imbalance")
TOTALS = {
    "avg_iteration_s": ("wall_time_s", np.mean),
    "total_comm_bytes": ("comm_bytes", np.sum),
    "total_barrier_wait_s": ("barrier_wait_s", np.sum),
    "total_compute_time_s": ("compute_time_s", np.sum),
    "avg_load_imbalance": ("load_imbalance", np.mean),
    "max_driver_rss_mb": ("driver_rss_mb", np.max),
}


def spread(seconds: list[float]) -> dict[str, float]:
    """``TASK_FIELDS`` of task times; all 0 without tasks, no deviation of a single one."""
    times = np.array(seconds or [0.0])
    low, high = times.min(), times.max()
    told = (low, high, times.mean(), times.std(ddof=1) if len(times) > 1 else 0.0, (high - low) / high if high > 0 else 0.0)
    return dict(zip(TASK_FIELDS, map(float, told), strict=True))


@dataclass
class Stage:
    """A stage that ran: when it ended (seconds since the epoch), its tasks' run times, bytes it shuffled out."""

    ended: float
    seconds: list[float]
    shuffled: int


def stages_since(spark: SparkSession, began: float) -> list[Stage]:
    """The completed stages that were submitted since then, of those that Spark still keeps (``spark.ui.retainedStages``)."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty()
    store, out = context.statusStore(), []
    mapper = jvm.com.fasterxml.jackson.databind.ObjectMapper()
    mapper.registerModule(jvm.com.fasterxml.jackson.module.scala.DefaultScalaModule())
    jobs = json.loads(mapper.writeValueAsString(store.jobsList(None)))
    recent = [j for j in jobs if j["submissionTime"] is not None and j["submissionTime"] / 1000 >= began]
    for number in sorted({s for j in recent for s in j["stageIds"]}):
        try:
            found = store.lastStageAttempt(number)
        except Py4JJavaError:  # no longer kept
            continue
        if found.status().toString() != "COMPLETE":
            continue
        tasks = json.loads(mapper.writeValueAsString(store.taskList(number, found.attemptId(), found.numTasks())))
        seconds = [t["taskMetrics"]["executorRunTime"] / 1000 for t in tasks if t["taskMetrics"]]
        out.append(Stage(found.completionTime().get().getTime() / 1000, seconds, found.shuffleWriteBytes()))
    return out


@dataclass
class Iteration:
    """What is known of one iteration."""

    iteration: int
    wall_time_s: float
    delta: float
    comm_bytes: int = 0
    barrier_wait_s: float = 0.0
    compute_time_s: float = 0.0
    driver_rss_mb: float = 0.0
    task_times_s: list[float] = field(default_factory=list)
    dirty_node_count: int | None = None

    def row(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "task_times_s"} | spread(self.task_times_s)


@dataclass
class RunStats:
    """A run's name, settings, iterations and further figures."""

    run_name: str
    metadata: dict = field(default_factory=dict)
    iterations: list[Iteration] = field(default_factory=list)
    extras: dict = field(default_factory=dict)
    total_wall_time_s: float = 0.0

    def rows(self) -> list[dict]:
        return [i.row() for i in self.iterations]

    def summary(self) -> dict:
        rows = self.rows()
        head = {"run_name": self.run_name, "metadata": self.metadata, "total_wall_time_s": self.total_wall_time_s, "num_iterations": len(rows)}
        totals = {name: how([r[of] for r in rows]).item() if rows else 0.0 for name, (of, how) in TOTALS.items()}
        return head | totals | {"final_delta": rows[-1]["delta"] if rows else None, "extras": self.extras}

    def as_dict(self) -> dict:
        return self.summary() | {"iterations": self.rows()}


def measured(spark: SparkSession, name: str, metadata: dict, run) -> tuple[Ranks, RunStats]:
    """``run()`` -> Ranks, and what it took."""
    began = time.time()
    ranks = run()
    ended = time.time()
    stages = stages_since(spark, began)
    resident = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024  # KB on Linux
    rows, since = [], began
    for done, at in ranks.blocks:
        own = [s for s in stages if (since <= s.ended or since == began) and s.ended < at]
        times = [t for s in own for t in s.seconds]
        waits = sum(max(s.seconds) - sum(s.seconds) / len(s.seconds) for s in own if s.seconds)
        for _ in range(done):
            number = len(rows) + 1
            rows.append(Iteration(number, (at - since) / done, ranks.deltas[number - 1], sum(s.shuffled for s in own) // done, waits / done, sum(times) / done, resident, times))
        since = at
    extras = {"stages": len(stages), "tasks": sum(len(s.seconds) for s in stages), "shuffle_bytes": sum(s.shuffled for s in stages)}
    return ranks, RunStats(name, metadata, rows, extras, ended - began)
