"""python -m plumbline --log FILE [--stdout FILE] [--script FILE] [--prompt NAME] [--answer FILE] --out FOLDER

Files and the folder may be in any store that the session reads."""

from __future__ import annotations

import argparse
import os

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from plumbline import report
from plumbline.sources import logs, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--log", help="driver log")
    which.add_argument("--env", help="environment variable that names the driver log")
    p.add_argument("--stdout", help="output of the job, with explain() text")
    p.add_argument("--script", help="the job's Python script")
    p.add_argument("--script-mode", choices=("whole", "excerpt", "none"), default="excerpt", help="how much of the script goes into documents")
    p.add_argument("--prompt", help="template of a prompt by name or path, to which the summary is added; `auto` takes the one for what is given")
    p.add_argument("--max-tokens", type=int, help="tokens that the message may have; the summary gets smaller until it fits")
    p.add_argument("--summary", help="where the summary goes, if not into the folder")
    p.add_argument("--answer", help="an answer about the run, to be checked")
    p.add_argument("--model", help="who gave the answer, as a note beside it")
    p.add_argument("--force", action="store_true", help="check an answer that is stored as one to another message")
    p.add_argument("--out", required=True, help="folder for the documents")
    return p.parse_args(argv)


def guarded(a: argparse.Namespace, spark: SparkSession | None = None) -> str:
    """The log's path; inputs must differ, exist and be of the right kind, and outputs must not replace them."""
    log = a.log or os.environ.get(a.env or "", "")
    same = lambda x, y: x.removeprefix("file://").rstrip("/") == y.removeprefix("file://").rstrip("/")
    try:
        found = bool(log) and not log.endswith(".json") and logs.listing(spark or SparkSession.builder.getOrCreate(), log).count() == 1
    except PySparkException:
        found = False
    if not found:
        raise SystemExit(f"not a log file: {log}")
    if a.script and not a.script.endswith(".py"):
        raise SystemExit("a script's name ends in .py")
    if a.stdout and same(a.stdout, log):
        raise SystemExit("the output and the log are the same file")
    if same(a.out, log):
        raise SystemExit("the folder for documents is the log")
    return log


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log = guarded(a, spark)
    read = lambda p: logs.text_of(spark, p) if p else None
    at = lambda name: f"{a.out.rstrip('/')}/{name}"
    run, document = report.analysed(spark, log, read(a.stdout), read(a.script), a.script_mode, os.path.basename(a.script or "script.py"))
    extras = {k: document[k] for k in ("plan", "script") if k in document}
    version = report.prompt_version(None, "plan" in extras, "script" in extras)
    prompt = report.prompt_text(version if a.prompt == "auto" else a.prompt) if a.prompt else ""
    shown, profile = report.fitted(run, document, prompt, a.max_tokens, extras)
    text = report.message(prompt, shown)
    if a.max_tokens and report.tokens(text) > a.max_tokens:
        print(f"the smallest message has about {report.tokens(text)} tokens")
    if a.prompt:
        sinks.write_text(text, at(f"prompt_{version}.md"), spark)
    checked = None
    if a.answer:
        answer, tries = report.asked(lambda _: logs.text_of(spark, a.answer), "")
        if "message_sha256" in answer:
            if not a.force and not report.fresh(answer, text):
                raise SystemExit("the answer is to another message; --force checks it all the same")
            answer = answer["answer"]
        checked, totals, objections = report.verified(spark, answer, shown, document.get("class"))
        sinks.write_document({"evidence": checked, "totals": totals, "objections": objections, "tries": tries}, at("answer_checks.json"), spark=spark)
        sinks.write_document(report.stored_answer(answer, text, a.model), at("answer.json"), spark=spark)
        sinks.write_text(report.draft(objections, os.path.basename(log)), at("review.md"), spark)
    sinks.write_document(document, at("report.json"), spark=spark)
    sinks.write_document(shown, a.summary or at("summary.json"), compact=True, spark=spark)
    sinks.write_text(report.markdown(document, document.get("plan"), checked), at("report.md"), spark)
    print(f"{report.console(document)}\nsummary: {profile}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
