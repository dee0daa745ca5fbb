"""python -m plumbline.menu --logs FOLDER --scripts FOLDER --out FOLDER: choose a log, what goes with it, and what to do."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import __main__ as command
from plumbline.functions.text import basename, human_bytes
from plumbline.sources import logs

#: What can be done: title, and the arguments that it adds to a run.
ACTIONS = [
    ("Report on the log", []),
    ("Report, and a message with the summary", ["--prompt", "auto"]),
    ("Report, and a message of 6,000 tokens at most", ["--prompt", "auto", "--max-tokens", "6000"]),
    ("Check a stored answer", ["--answer"]),
]
MOST = 200  # files that are offered


def offered(files: DataFrame) -> list[tuple[str, str]]:
    """(path, what is shown for it) of the first MOST files."""
    shown = F.concat(basename(F.col("path")), F.lit("  "), human_bytes(F.col("length")))
    return [(r["path"], r["shown"]) for r in files.select("path", shown.alias("shown")).limit(MOST).collect()]


def chosen(title: str, options: list[tuple[str, str]], ask: Callable[[str], str], none: bool = False) -> str | None:
    """The option whose number is given; nothing stands for none of them, where that is allowed."""
    print(title)
    for i, (_, said) in enumerate(options, 1):
        print(f"  {i}  {said}")
    while True:
        said = ask("number" + (", or nothing: " if none else ": ")).strip()
        if not said and none:
            return None
        if said.isdigit() and 1 <= int(said) <= len(options):
            return options[int(said) - 1][0]
        print(f"a number from 1 to {len(options)}, please")


def partner(table: DataFrame, column: str, options: list[tuple[str, str]], title: str, ask: Callable[[str], str]) -> str | None:
    """The file that is paired with the log by name, if that is agreed to, else one that is chosen."""
    found = table.first()
    if found is not None and not ask(f"{title}: take {found[column]}? (nothing: yes) ").strip():
        return found[column]
    return chosen(title, options, ask, none=True) if options else None


def assembled(spark: SparkSession, a: argparse.Namespace, ask: Callable[[str], str]) -> list[str] | None:
    """Arguments for a run, by questions; none where there is nothing to choose from."""
    files = logs.logs_in(spark, a.logs)
    options = offered(files)
    if not options:
        print(f"no logs in {a.logs}")
        return None
    action = chosen("What to do", [(str(i), title) for i, (title, _) in enumerate(ACTIONS)], ask)
    log = chosen("Log", options, ask)
    out = ["--log", log, "--out", a.out]
    one = spark.createDataFrame([(log,)], "path string")
    others = files.where(F.col("path") != log)
    output = partner(logs.paired_outputs(one, others), "output", [o for o in options if o[0] != log], "Output of the job", ask)
    out += ["--stdout", output] if output else []
    if a.scripts:
        scripts = logs.scripts_in(spark, a.scripts)
        script = partner(logs.paired_scripts(one.select(basename(F.col("path")).alias("name")), scripts), "path", offered(scripts), "Script", ask)
        out += ["--script", script] if script else []
    extra = ACTIONS[int(action)][1]
    return out + extra + ([ask("file of the answer: ").strip()] if extra == ["--answer"] else [])


def main(argv: list[str] | None = None, ask: Callable[[str], str] = input) -> int:
    p = argparse.ArgumentParser(prog="plumbline.menu", description=__doc__)
    p.add_argument("--logs", required=True)
    p.add_argument("--scripts")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = assembled(spark, a, ask)
    return 1 if found is None else command.main(found)


if __name__ == "__main__":
    raise SystemExit(main())
