"""compile_plan(...).run(...): from a pattern to a count."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, replace
from statistics import fmean, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .operators import formulas, match
from .patterns import Pattern
from .plans.inclusion_exclusion import SuffixCount, last_count, suffix_count
from .plans.pruning import PRUNING, Auxiliary, place
from .plans.schedule import SCHEDULERS, Schedule, Stats, schedule

QUERY_TYPES = ("vertex", "edge", "edge_iep")
PARALLEL = ("openmp", "tbb_top", "nested", "nested_rt")
LOWERINGS = ("join", "array")
_ALIASES = {"vertex_induced": "vertex", "edge_induced": "edge", "edge_induced_iep": "edge_iep", "cost_model": "costmodel", "tbbtop": "tbb_top", "nestedrt": "nested_rt"}


def token(value: str, known: tuple[str, ...], what: str) -> str:
    """A normalised option: case and - or _ do not matter."""
    t = str(value).strip().lower().replace("-", "_")
    t = _ALIASES.get(t, t)
    if t not in known:
        raise ValueError(f"unknown {what} {value!r}; known: {', '.join(known)}")
    return t


@dataclass(frozen=True)
class RunResult:
    num_matches: int
    seconds: float
    finished: bool = True
    threads: int = 0
    query_type: str = ""
    #: Of the tasks, if asked for: seconds (least, mean, most, standard deviation), and bytes of execution memory.
    task_seconds: tuple[float, float, float, float] | None = None
    allocated: int | None = None

    @property
    def result(self) -> int:
        return self.num_matches

    @property
    def matches_per_second(self) -> float:
        return self.num_matches / self.seconds if self.seconds else 0.0

    def __repr__(self) -> str:
        state = "" if self.finished else ", timed out"
        return f"RunResult(num_matches={self.num_matches}, seconds={self.seconds:.3f}{state})"


@dataclass
class CompiledPlan:
    """A plan for one pattern; graphs other than the compiled-for one may be given to run."""

    graph: Graph
    schedule: Schedule
    query_type: str
    pruning_type: str
    parallel_type: str
    auxiliary: Auxiliary
    suffix: SuffixCount | None
    lowering: str
    plan_seconds: float = 0.0

    module_path = None

    @property
    def pattern_size(self) -> int:
        return self.schedule.pattern.size

    def describe(self) -> str:
        lines = [f"{self.query_type} matching by {self.lowering} lowering", self.schedule.describe(), self.auxiliary.describe()]
        return "\n".join(lines + ([self.suffix.describe()] if self.suffix else []))

    def relations(self, graph: Graph | None = None) -> match.Relations:
        return match.Relations(graph or self.graph)

    def matches(self, graph: Graph | None = None) -> DataFrame:
        """The occurrences themselves: v0 .. v{k-1} by matching order, each once."""
        r, induced = self.relations(graph), self.query_type == "vertex"
        if self.lowering == "array":
            return match.array_matches(self.schedule, r, induced)
        return match.matches(self.schedule, r, induced, self._auxiliary(r, None))

    def _auxiliary(self, r: match.Relations, last: int | None) -> Auxiliary:
        """Beyond the broadcast bound candidates and tests would be shuffled, of which there are far more than triangles: all
        levels that can read common neighbours, whatever the pruning type."""
        return self.auxiliary if r.small else place(self.schedule, "eager", Stats(), last)

    def counts(self, graph: Graph | None = None) -> DataFrame:
        """One row, one column: matches. Of the levels, nothing runs until it is read."""
        g = (graph or self.graph).ranked()
        if self.lowering == "join" and self.pattern_size <= 4:
            return formulas.count(self.schedule.pattern, self.relations(g), self.query_type == "vertex")
        r, induced = self.relations(g), self.query_type == "vertex"
        if self.lowering == "array":
            return match.array_matches(self.schedule, r, induced).agg(F.count("*").alias("matches"))
        if self.suffix is not None:
            return match.suffix_counts(self.schedule, self.suffix, r, self._auxiliary(r, self.suffix.prefix if self.query_type == "edge_iep" else None))
        return match.matches(self.schedule, r, induced, self._auxiliary(r, None)).agg(F.count("*").alias("matches"))

    @property
    def generated_code(self) -> str:
        return self.counts()._jdf.queryExecution().optimizedPlan().toString()

    def explain(self, mode: str = "formatted") -> None:
        self.counts().explain(mode)

    def run(self, graph: Graph | None = None, num_threads: int = 0, timeout: float | None = None, metrics: bool = False) -> RunResult:
        """Counts. num_threads is recorded only: parallelism is the cluster's. After timeout seconds the job is cancelled.
        metrics: with the times of up to TASKS tasks and the execution memory of the stages, as Spark's status store has them."""
        spark = (graph or self.graph).edges.sparkSession
        out: dict = {}
        tag = f"graphloom-{uuid.uuid4().hex}"

        def work() -> None:
            spark.addTag(tag)
            try:
                out["n"] = self.counts(graph).first()[0]
            except Exception as e:  # handed to the caller's thread
                out["error"] = e
            finally:
                spark.removeTag(tag)

        began = time.perf_counter()
        if timeout is None:
            work()
        else:
            t = threading.Thread(target=work, daemon=True)
            t.start()
            t.join(timeout)
            if t.is_alive():
                spark.interruptTag(tag)
                t.join(10)
                return RunResult(0, time.perf_counter() - began, False, num_threads, self.query_type)
        if "error" in out:
            raise out["error"]
        result = RunResult(out["n"], time.perf_counter() - began, True, num_threads, self.query_type)
        return replace(result, **_task_metrics(spark, tag)) if metrics else result

    def profile(self, graph: Graph | None = None) -> DataFrame:
        """(level, vid, reads): how often each vertex's list is read at each level, for degree, offset or
        triangle breakdowns by a join with the graph's statistics."""
        induced = self.query_type == "vertex"
        r = self.relations(graph)
        out = None
        for level in range(1, self.pattern_size):
            rows = match.matches(self.schedule, r, induced, self.auxiliary, level)
            part = rows.groupBy(F.col(f"v{level - 1}").alias("vid")).agg(F.count("*").alias("reads")).select(F.lit(level - 1).alias("level"), "vid", "reads")
            out = part if out is None else out.unionByName(part)
        return out

    def work(self, graph: Graph | None = None) -> DataFrame:
        """(level, vid, reads, neighbours, auxiliary, tests): work by the vertex whose list a level reads (match.work)."""
        return match.work(self.schedule, self.relations(graph), self.query_type == "vertex", self.auxiliary)


TASKS = 2000


def _task_metrics(spark, tag: str) -> dict:
    """Figures of the jobs with a tag."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    store, times, allocated = sc.statusStore(), [], 0
    jobs = store.jobsList(None).iterator()
    while jobs.hasNext():
        job = jobs.next()
        if not any(tag in str(t) for t in _each(job.jobTags())):
            continue
        for stage in _each(job.stageIds()):
            for data in _each(store.stageData(int(str(stage)), False, spark.sparkContext._jvm.java.util.ArrayList(), False, _doubles(spark))):
                allocated += data.peakExecutionMemory()
                for task in _each(store.taskList(data.stageId(), data.attemptId(), max(0, TASKS - len(times)))):
                    if task.duration().isDefined():
                        times.append(task.duration().get() / 1000)
    return {"task_seconds": (min(times), fmean(times), max(times), pstdev(times)) if times else None, "allocated": allocated}


def _doubles(spark):
    return spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def compile_plan(graph: Graph, query_adjmat: str, query_type: str, pruning_type: str = "eager", parallel_type: str = "nested_rt", scheduler: str = "cost", lowering: str = "join") -> CompiledPlan:
    """Plans a pattern on a graph. scheduler: structural ignores the graph, cost and density use its statistics."""
    began = time.perf_counter()
    kind, pruning = token(query_type, QUERY_TYPES, "query type"), token(pruning_type, PRUNING, "pruning type")
    parallel, how = token(parallel_type, PARALLEL, "parallel type"), token(scheduler, SCHEDULERS, "scheduler")
    pattern = Pattern(query_adjmat)
    stats = graph.stats if pruning == "costmodel" else graph.metadata.stats if how != "structural" else Stats()
    s = schedule(pattern, how, stats)
    lower = token(lowering, LOWERINGS, "lowering")
    suffix = suffix_count(s) if kind == "edge_iep" else last_count(s) if kind == "edge" and lower == "join" else None
    aux = place(s, pruning, stats, suffix.prefix if suffix and kind == "edge_iep" else None)
    return CompiledPlan(graph, s, kind, pruning, parallel, aux, suffix, lower, time.perf_counter() - began)

