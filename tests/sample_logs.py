"""Logs with known contents, written line by line."""

from __future__ import annotations


class Log:
    def __init__(self):
        self.lines: list[str] = []
        self.second, self.tid = 0, 0

    def say(self, text: str, level: str = "INFO", component: str = "DAGScheduler", step: int = 0) -> "Log":
        self.second += step
        s = self.second
        self.lines.append(f"24/01/01 {10 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d} {level} {component}: {text}")
        return self

    def raw(self, *lines: str) -> "Log":
        self.lines += lines
        return self

    def begin(self, executors: int = 1, cores: int = 1) -> "Log":
        self.say("Running Spark version 3.5.6").say("Submitted application: demo").say(f"Using effectiveMaxExecutors = {executors}")
        return self.say(f"Default ResourceProfile created, executor resources: Map(cores -> name: cores, amount: {cores}, script: , vendor: )")

    def job(self, n: int, stage: int, tasks: list[int], action: str = "count at job.py:12", kind: str = "ResultStage", submitted: int | None = None, fail: tuple[int, ...] = (), attempt: int = 0, took: float = 2.5, open_job: bool = True) -> "Log":
        if open_job:
            self.say(f"Got job {n} ({action}) with {len(tasks)} output partitions")
        self.say(f"Submitting {kind} {stage} (MapPartitionsRDD[3] at {action}), which has no missing parents")
        self.say(f"Submitting {submitted or len(tasks)} missing tasks from {kind} {stage} (MapPartitionsRDD[3] at {action}) (first 15 tasks are for partitions Vector(0, 1))")
        for i, ms in enumerate(tasks):
            t = self.tid
            self.tid += 1
            self.say(f"Starting task {i}.0 in stage {stage}.{attempt} (TID {t}) (10.0.0.{1 + i % 2}, executor {1 + i % 2}, partition {i}, PROCESS_LOCAL, 9771 bytes)", component="TaskSetManager")
            if i in fail:
                self.say(f"Lost task {i}.0 in stage {stage}.{attempt} (TID {t}) (10.0.0.{1 + i % 2} executor {1 + i % 2}): java.io.IOException: gone", "WARN", "TaskSetManager")
            else:
                self.say(f"Finished task {i}.0 in stage {stage}.{attempt} (TID {t}) in {ms} ms on 10.0.0.{1 + i % 2} (executor {1 + i % 2}) ({i + 1}/{len(tasks)})", component="TaskSetManager")
        return self

    def end_stage(self, stage: int, took: float = 2.5, kind: str = "ResultStage", action: str = "count at job.py:12") -> "Log":
        return self.say(f"{kind} {stage} ({action}) finished in {took} s", step=int(took))

    def end_job(self, n: int, took: float = 2.612345, action: str = "count at job.py:12") -> "Log":
        self.say(f"Job {n} is finished. Cancelling potential speculative or zombie tasks for this job")
        return self.say(f"Job {n} finished: {action}, took {took} s")

    def end(self, code: int = 0, step: int = 0) -> "Log":
        return self.say(f"SparkContext is stopping with exitCode {code}.", component="SparkContext", step=step)

    @property
    def text(self) -> str:
        return "\n".join(self.lines)


def whole(tasks: list[int], **kw) -> Log:
    return Log().begin(**{k: kw.pop(k) for k in ("executors", "cores") if k in kw}).job(0, 0, tasks, **kw).end_stage(0).end_job(0).end()
