"""Documents of a run: the report, summaries of it in three sizes, Markdown, and the message that goes with a prompt."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import masking
from plumbline.operators import checks, evidence, findings, records, review, runs, score, stats
from plumbline.plans import explain, links, script, signals
from plumbline.sources import logs
from plumbline.sources.sinks import stored


class Run:
    """Tables of logs. Those that most others read are written to the session's shared folder once, which also keeps the
    plans of the others short."""

    def __init__(self, lines: DataFrame, thresholds: config.Thresholds = config.Thresholds(), weights: config.Weights = config.Weights(), mask: bool = True):
        self.thresholds, self.weights = thresholds, weights
        events, reading = records.parsed(lines)
        self.events, self.reading = stored(events, "events"), stored(reading, "reading")
        self.attempts = stored(runs.stage_attempts(self.events), "attempts")
        self.sites = runs.call_sites(self.events)
        self.spans = runs.duration(self.events)
        self.capacity = stored(runs.capacity(self.events, self.attempts, self.spans), "capacity")
        self.context = runs.context(self.events)
        self.failures = runs.failures(self.events)
        self.findings = stored(findings.findings(self.events, self.attempts, self.sites, self.capacity, thresholds), "findings")
        self.alerts = stored(checks.consistency(self.events, self.reading, self.attempts, self.spans, thresholds), "alerts")
        self.verdicts = checks.verdict(self.alerts, self.reading)
        self.deductions = score.deductions(self.events, self.attempts, self.findings, self.context, weights)
        self.scores = score.scores(self.deductions, self.verdicts, weights)
        self.classes = evidence.class_of_runs(self.verdicts, self.context, self.failures, self.attempts, self.findings)
        self.mask = mask

    def masked_warnings(self) -> tuple[DataFrame, DataFrame]:
        """Unmatched warnings with their texts masked, and the pseudonyms of all hosts and paths."""
        held = runs.of_type(self.events, config.UNMATCHED).select("log_id", "seq", "level", "component", runs.field("msg").alias("msg"), "stack")
        return masking.masked(held, ["log_id", "seq"], ["msg"])

    def warning_groups(self, profile: config.Profile) -> tuple[list[dict], int]:
        """The commonest templates of warnings, each with its first example, and how many groups are left out."""
        held = self.masked_warnings()[0] if self.mask else runs.of_type(self.events, config.UNMATCHED).select("log_id", "seq", "level", "component", runs.field("msg").alias("msg"), "stack")
        groups = stats.template_groups(held, "msg", "seq", ["level", "component"], profile.chars)
        stacks = held.select(F.col("seq").alias("first_seq"), F.slice("stack", 1, max(1, profile.stack_lines)).alias("stack"))
        total = groups.count()
        top = stats.top_k(groups, [F.desc("n"), F.asc("first_seq")], profile.warnings).join(stacks, "first_seq", "left").orderBy(F.desc("n"), "first_seq")
        rows = [r.asDict(recursive=True) for r in top.collect()]
        for r in rows:
            r["example"] = cut(r["example"], profile.chars)
            if not profile.stack_lines:
                r.pop("stack")
        return rows, total - len(rows)


def plain(value):
    """What JSON can hold; nulls and empty maps are left out of objects."""
    if isinstance(value, dict):
        return {str(k): v for k, x in value.items() if (v := plain(x)) is not None and v != {}}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value


def rows(df: DataFrame) -> list[dict]:
    """A table of bounded size, as documents."""
    return [plain(r.asDict(recursive=True)) for r in df.collect()]


def cut(text: str | None, width: int) -> str | None:
    return text if text is None or len(text) <= width else text[: width - 3] + "..."


def metadata(sha256: str | None = None, size: int | None = None, t: config.Thresholds = config.Thresholds(), w: config.Weights = config.Weights()) -> dict:
    return plain({"versions": config.VERSIONS, "log_sha256": sha256, "log_bytes": size, "thresholds": asdict(t), "weights": {**asdict(w), "findings": dict(w.findings)}})


def report(run: Run, log_id: str, meta: dict | None = None) -> dict:
    """The whole report of one log, which has a bounded number of stages, call sites and findings."""
    own = lambda df: df.where(F.col("log_id") == log_id).drop("log_id")
    one = lambda df: (rows(own(df)) or [{}])[0]
    found = rows(own(run.findings).orderBy("rank"))
    for f in found:
        f["id"] = f"A{f.pop('rank')}"
    order = F.array_position(F.array(*map(F.lit, checks.SEVERITY)), F.col("severity"))
    return plain(
        {
            "meta": meta or metadata(t=run.thresholds, w=run.weights),
            "reading": one(run.reading),
            "context": one(run.context),
            "duration": one(run.spans),
            "events": {r["event_type"]: r["n"] for r in rows(own(runs.event_counts(run.events)).orderBy(F.desc("n"), "first_seq"))},
            "capacity": one(run.capacity),
            "stages": rows(own(run.attempts).orderBy(*runs.stage_order())),
            "call_sites": rows(own(run.sites).orderBy(F.desc("total_s"), "first_seq")),
            "findings": found,
            "failures": rows(own(run.failures).orderBy("seq")),
            "consistency": {**one(run.verdicts), "alerts": rows(own(run.alerts).orderBy(order, "code"))},
            "score": {**one(run.scores), "deductions": rows(own(run.deductions))},
            "class": one(run.classes).get("class"),
            "unavailable": list(config.UNAVAILABLE),
        }
    )


def top_and_cited(items: list[dict], key: Callable[[dict], str], order: Callable[[dict], tuple], k: int, cited: set) -> tuple[list[dict], int]:
    chosen = {key(x) for x in sorted(items, key=order)[:k]} | cited
    kept = [x for x in items if key(x) in chosen]
    return kept, len(items) - len(kept)


def summary(run: Run, document: dict, profile: config.Profile = config.PROFILES[0]) -> dict:
    """The report cut to a profile: top stages and call sites and those that findings cite, grouped warnings."""
    cited = {f["evidence"]["stage_key"] for f in document["findings"] if "stage_key" in f.get("evidence", {})}
    actions = {f["evidence"]["action"] for f in document["findings"] if f["rule"] == "repeated_action"}
    stages, left_stages = top_and_cited(document["stages"], lambda s: s["stage_key"], lambda s: (-(s.get("duration_s") or 0),), profile.stages, cited)
    sites, left_sites = top_and_cited(document["call_sites"], lambda s: s["action"], lambda s: (-(s.get("total_s") or 0),), profile.call_sites, actions)
    warnings, left_warnings = run.warning_groups(profile)
    names = ("stage_key", "stage_kind", "status", "duration_s", "num_tasks", "submitted_tasks", "median_ms", "p95_ms", "max_ms", "skew_ratio", "num_failed", "failures_by_reason", "task_retries", "origin")
    reasons: dict[str, int] = {}
    for s in document["stages"]:
        for r, n in s.get("failures_by_reason", {}).items():
            reasons[r] = reasons.get(r, 0) + n
    drop = () if profile.texts else ("hypotheses", "investigate", "options", "thresholds")
    return plain(
        {
            "version": config.VERSIONS["summary"],
            "profile": profile.name,
            "run": {**document.get("context", {}), **document.get("duration", {}), "jobs": sum(s["num_jobs"] for s in document["call_sites"]), "stages": len(document["stages"])},
            "quality": {"consistent": document["consistency"].get("ok"), "alerts": document["consistency"]["alerts"], "score": document["score"].get("score"), "band": document["score"].get("band")},
            "capacity": document.get("capacity"),
            "findings": [{k: v for k, v in f.items() if k not in drop} for f in document["findings"]],
            "stages": [{k: s[k] for k in names if k in s} for s in stages],
            "call_sites": sites,
            "failures": {"by_reason": reasons, "details": document["failures"][: profile.failures], "left_out": max(0, len(document["failures"]) - profile.failures)},
            "warnings": warnings,
            "left_out": {"stages": left_stages, "call_sites": left_sites, "warnings": left_warnings},
            "unavailable": document.get("unavailable"),
        }
    )


def message(prompt: str, document: dict) -> str:
    return f"{prompt}\n\n{json.dumps(document, ensure_ascii=False, separators=(',', ':'))}"


def tokens(text: str, per_token: float = 3.5) -> int:
    return int(len(text) / per_token)


def fitted(run: Run, document: dict, prompt: str, limit: int | None, extras: dict | None = None) -> tuple[dict, str]:
    """The first summary that a budget of tokens holds: profiles from the largest, each with all extras, then with less."""
    extras = extras or {}
    last = None
    for profile in config.PROFILES:
        base = summary(run, document, profile)
        for kept in smaller(extras):
            last = {**base, **kept}
            if limit is None or tokens(message(prompt, last)) <= limit:
                return last, profile.name
    return last, config.PROFILES[-1].name


def smaller(extras: dict) -> list[dict]:
    """The extras of a summary, and less of them by steps: without the plan's nodes, the script's lines but those that
    the log names, the whole script, everything."""
    steps = [extras]
    if "plan" in extras:
        steps.append(steps[-1] | {"plan": explain.without_nodes(extras["plan"])})
    if "script" in extras:
        cited = {str(r["line"]) for r in extras["script"].get("log", [])}
        steps.append(steps[-1] | {"script": extras["script"] | {"lines": {n: x for n, x in extras["script"].get("lines", {}).items() if n in cited}}})
        steps.append({k: v for k, v in steps[-1].items() if k != "script"})
    return [*steps, {}]


def plan_block(spark: SparkSession, run: Run, document: dict, log_id: str, output: str, source: str | None = None) -> dict:
    """Plans, signals, links, phases and candidates of one run, from its output and its script."""
    held = spark.createDataFrame([(log_id, output)], "source string, text string")
    nodes = stored(explain.plan_nodes(held), "plan-nodes")
    found = stored(signals.signals(nodes), "signals")
    signal_rows = rows(found.orderBy("plan_no", "id"))
    for s in signal_rows:
        s.setdefault("keys", [])
        s.setdefault("names", [])
        s.setdefault("subject", None)
    own = run.events.where(F.col("log_id") == log_id), run.attempts.where(F.col("log_id") == log_id)
    log_rows = [r.asDict(recursive=True) for r in links.log_links(found, *own).collect()]
    facts = script.facts(source) if source else None
    usage = script.Usage(facts) if facts else None
    crossed = links.cross_links(signal_rows, log_rows, usage)
    _, outside, warnings = explain.sections(output)
    marks = links.markers(outside)
    if source and facts is None:
        warnings.append("the script can't be read as Python")
    span = run.spans.where(F.col("log_id") == log_id).first()
    state = links.coherence(marks, span and span["first_ts"], span and span["last_ts"])
    capacity = document.get("capacity", {})
    phase_rows: list[dict] = []
    if state["status"] == "ok":
        constants = [(f["line"], f["name"]) for f in facts or [] if f["kind"] == "constant"]
        ends = links.points(marks, span["first_ts"], span["last_ts"], constants)
        table = links.phases(spark, ends, *own, capacity.get("slots"), run.findings.where(F.col("log_id") == log_id))
        phase_rows = [r.asDict(recursive=True) for r in table.collect()]
    low = next((f["id"] for f in document["findings"] if f["rule"] == "low_occupancy"), None)
    stage_rows = {s["stage_key"]: s for s in document["stages"]}
    ranked = links.candidates(signal_rows, crossed, phase_rows, stage_rows, facts or [], capacity, low)
    out = {
        "version": config.VERSIONS["plan"], "operators": rows(explain.histogram(nodes).drop("source").orderBy("plan_no", F.desc("n"), "op")), "signals": signal_rows, "links": crossed,
        "markers": marks, "coherence": state, "phases": phase_rows, "candidates": ranked, "warnings": warnings,
        "nodes": rows(nodes.where("node_id IS NOT NULL").drop("source", "ancestors", "signature").orderBy("plan_no", "idx").limit(120)),
        "sha256": hashlib.sha256(output.encode()).hexdigest(),
    }
    return plain(out)


def script_block(source: str, name: str, run: Run, log_id: str, whole: bool = False) -> dict:
    """The script without comments and secrets, with what the log says of its lines."""
    lines, counts = script.cleaned(source)
    tied = rows(links.call_site_lines(run.sites.where(F.col("log_id") == log_id), run.attempts.where(F.col("log_id") == log_id), name).orderBy("line"))
    shown = lines if whole else script.excerpt(lines, {r["line"] for r in tied})
    return {"version": config.VERSIONS["script"], "name": name, "sha256": hashlib.sha256(source.encode()).hexdigest(), "masked": counts, "lines": {str(i): x for i, x in shown.items()}, "log": tied}


# ------------------------------------------------------------------ Markdown
def cell(value) -> str:
    text = "" if value is None else str(value)
    return re.sub(r"\s+", " ", text).replace("|", "\\|")


def grid(head: list[str], body: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in body), ""]


def length(seconds: float | None) -> str:
    if seconds is None:
        return "unknown"
    return f"{seconds:.1f} s" if seconds < 60 else f"{int(seconds) // 60} min {int(seconds) % 60:02d} s"


def folded(title: str, lines: list[str]) -> list[str]:
    return [f"<details><summary>{title}</summary>", "", *lines, "</details>", ""]


def markdown(document: dict, block: dict | None = None, checked: list[dict] | None = None) -> str:
    """The report for people."""
    score_, span = document["score"], document.get("duration", {})
    out = ["# Run report", "", f"Class **{document.get('class')}**, score **{score_.get('score', 'none')}** ({score_.get('band', 'not given')}), {length(span.get('duration_s'))}.", ""]
    if block and block.get("candidates"):
        out += ["## What to do", "", *grid(["id", "what", "cost", "where", "action"], [[c["id"], c["title"], length(c["cost_s"]), json.dumps(c["where"]), c["action"]] for c in block["candidates"]])]
    out += ["## Findings", "", *grid(["id", "severity", "rule", "title"], [[f["id"], f["severity"], f["rule"], f["title"]] for f in document["findings"]])]
    for f in document["findings"]:
        out += folded(f"{f['id']} {f['title']}", [*(f"- {h}" for h in f["hypotheses"]), "", f"Look at: {f['investigate']}", "", *(f"- {o}" for o in f["options"]), ""])
    if block and block.get("phases"):
        out += ["## Phases", "", *grid(["id", "from", "to", "time", "jobs", "stages", "occupancy %"], [[p["id"], p["from_msg"], p["to_msg"], length(p["duration_s"]), p["jobs"], p["stages"], p.get("occupancy_pct")] for p in block["phases"]])]
    names = ["stage_key", "status", "num_tasks", "median_ms", "p95_ms", "max_ms", "skew_ratio", "duration_s"]
    out += ["## Stages", "", *folded(f"{len(document['stages'])} attempts", grid(names, [[s.get(n) for n in names] for s in document["stages"]]))]
    out += ["## Call sites", "", *folded(f"{len(document['call_sites'])} call sites", grid(["action", "jobs", "total", "mean"], [[s["action"], s["num_jobs"], s["total_s"], s["mean_s"]] for s in document["call_sites"]]))]
    out += ["## Checks", "", *grid(["code", "severity", "expected", "observed"], [[a["code"], a["severity"], a.get("expected"), a.get("observed")] for a in document["consistency"]["alerts"]])]
    out += ["## Deductions", "", *grid(["criterion", "points", "capped"], [[d["criterion"], d["points"], d["capped"]] for d in score_["deductions"]])]
    if checked:
        out += ["## Evidence", "", *grid(["where", "path", "cited", "actual", "status"], [[c.get(k) for k in ("where", "path", "cited", "actual", "status")] for c in checked])]
    return "\n".join(out)


# ------------------------------------------------------------------ answers
def prompt_version(chosen: str | None, with_plan: bool, with_script: bool) -> str:
    """The prompt that is asked for, else the one for what is there: a plan, a script, or the log alone."""
    return chosen or ("plan" if with_plan else "script" if with_script else "log")


PROMPTS = resources.files("plumbline") / "prompts"


def prompt_template(name: str, folder: str | None = None) -> str:
    """A template by its name, whatever its case, with or without the ending: from a folder, or of those that come with
    the package; else the file of that path."""
    held = Path(folder) if folder else PROMPTS
    by_name = {p.name.lower(): p for p in held.iterdir()}
    found = by_name.get(name.lower()) or by_name.get(f"{name.lower()}.md")
    if found is None and not Path(name).is_file():
        raise FileNotFoundError(f"no prompt {name} in {held}; there are {', '.join(sorted(by_name))}")
    return (found or Path(name)).read_text(encoding="utf-8")


def prompt_text(name: str, folder: str | None = None) -> str:
    """A prompt's template without its leading comment, and with the shape of an answer where it asks for one."""
    text = re.sub(r"\A\s*<!--.*?-->\s*", "", prompt_template(name, folder), flags=re.S)
    return text.replace("{schema}", json.dumps(answer_schema(), separators=(",", ":")))


def answer_schema() -> dict:
    """The columns of an answer, as a JSON document."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(review.ANSWER).jsonValue()


def contract_gaps(text: str) -> list[str]:
    """Duties that a prompt doesn't state: what the checks of an answer rely on must have been asked for."""
    return [duty for duty, words in CONTRACT.items() if not re.search(words, text, re.I | re.S)]


#: Duties of every prompt, and the words by which one is known to state them.
CONTRACT = {
    "evidence has a path and a value": r"\bpaths?\b.*\bvalues?\b",
    "hypotheses are worded as such": r"\bhypothes[ie]s\b",
    "no thresholds are made up": r"thresholds?",
    "INFO alone is no bottleneck": r"\bINFO\b.*no bottleneck",
    "priorities follow severities": r"\bHIGH\b.*\bMEDIUM\b",
    "classes are named": r"inconclusive.*failed.*degraded.*healthy",
    "the answer's shape is given": r"\{schema\}|bottlenecks",
}


def replayed(path: str) -> Callable[[str], str]:
    """A provider that answers from a file."""

    def answer(_: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    return answer


def asked(provider: Callable[[str], str], text: str, tries: int = 2) -> tuple[dict, int]:
    """The first answer that can be read, with what was wrong told after each that can't."""
    wrong = None
    for n in range(1, tries + 1):
        said = provider(text if wrong is None else f"{text}\n\nThe answer before could not be read: {wrong}")
        try:
            return review.repaired_json(said), n
        except ValueError as e:
            wrong = str(e)[:500]
    raise ValueError(wrong)


def stored_answer(answer: dict, text: str, model: str | None = None) -> dict:
    return {"answer": answer, "model": model, "message_sha256": hashlib.sha256(text.encode()).hexdigest()}


def fresh(stored: dict, text: str) -> bool:
    """Whether a stored answer is one to this very message."""
    return stored.get("message_sha256") == hashlib.sha256(text.encode()).hexdigest()


def verified(spark: SparkSession, answer: dict, document: dict, expected: str) -> tuple[list[dict], dict, list[dict]]:
    """Evidence checks, their totals, and what the review rules object to."""
    claims = [("classification", e["path"], str(e["value"])) for e in answer.get("evidence", [])]
    claims += [(b["id"], e["path"], str(e["value"])) for b in answer.get("bottlenecks", []) for e in b.get("evidence", [])]
    held = evidence.evidence_checks(spark.createDataFrame(claims, "where string, path string, cited string"), evidence.flattened(spark, document))
    lines = [int(n) for n in (document.get("script") or {}).get("lines", {})]
    names = [c["id"] for c in (document.get("plan") or {}).get("candidates", [])]
    objections = review.review(spark, review.answer_table(spark, answer), document, held, expected, lines, names)
    return rows(held), rows(evidence.totals(held))[0], rows(objections)


def draft(objections: list[dict], name: str) -> str:
    """Objections as a form to be filled in."""
    out = [f"# Review of the answer on {name}", ""]
    if not objections:
        out.append("No objection was found by rule. Look at recommendations and priorities by hand.")
    for i, o in enumerate(objections, 1):
        out += [f"## {i}. {o['kind']} ({o['where']})", f"- said: {o.get('said')}", f"- found: {o.get('detail')}", "- decision: [ ] accepted [ ] corrected [ ] dropped", ""]
    return "\n".join(out)


def console(document: dict) -> str:
    """A few lines for a terminal."""
    verdict = document["consistency"]
    head = f"{document.get('class')}: score {document['score'].get('score')}, {len(document['stages'])} stage attempts, {length(document.get('duration', {}).get('duration_s'))}"
    return "\n".join([head, f"checks: {verdict.get('errors')} errors, {verdict.get('warnings')} warnings, {verdict.get('infos')} infos", *(f"{f['id']} {f['severity']} {f['title']}" for f in document["findings"])])


def analysed(spark: SparkSession, path: str, output: str | None = None, source: str | None = None, script_mode: str = "excerpt", name: str = "script.py") -> tuple[Run, dict]:
    """The run and the report of one log file, with the blocks of its plan and script where they are given.

    script_mode: the whole script, an excerpt around what the log names, or none of its lines."""
    run = Run(logs.raw_lines(spark, path))
    digest = logs.digests(spark, path).first() or {"sha256": hashlib.sha256().hexdigest(), "bytes": 0}  # empty files aren't listed
    log_id = (run.reading.select("log_id").first() or [path])[0]
    document = report(run, log_id, metadata(digest["sha256"], digest["bytes"], run.thresholds, run.weights))
    document["summary"] = summary(run, document)
    if output is not None:
        document["plan"] = plan_block(spark, run, document, log_id, output, source)
    if source is not None:
        document["script"] = script_block(source, name, run, log_id, script_mode == "whole")
        if script_mode == "none":
            document["script"]["lines"] = {}
    return run, document
