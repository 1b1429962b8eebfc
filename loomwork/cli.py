"""Command line: ``python -m loomwork.cli COMMAND PATH [--out PATH]``; JSON lines, to a folder or on screen."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import settings
from .operators import classify, extract, facts, flows, inventory, lineage, migrate, profile, rewrite, validate
from .session import local_session
from .sources.files import binary_files, code_files

#: Rows shown on screen.
SHOWN = 1000


def _profile(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return profile.profile(spark.read.parquet(a.path), a.columns.split(",") if a.columns else None, a.where)


def _code(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return code_files(spark, a.path, a.include, a.exclude).withColumn("key", F.monotonically_increasing_id())


def _lint(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return validate.issues(_code(spark, a), "path", "raw_code")


COMMANDS = {
    "profile": _profile,
    "extract": lambda s, a: extract.extract(_code(s, a), "path", "raw_code"),
    "lineage": lambda s, a: lineage.tables(_code(s, a), "path", "raw_code", not a.bare_names),
    "ctes": lambda s, a: lineage.ctes(_code(s, a), "path", "raw_code"),
    "classify": lambda s, a: classify.best(_code(s, a), "path", "raw_code", settings.engine_rules(a.rules) if a.rules else classify.ENGINE_RULES),
    "inventory": lambda s, a: inventory.duplicate_counts(inventory.attributes(binary_files(s, a.path).withColumn("path", F.regexp_replace("path", "^file:", "")), "path", "content"), "md5"),
    "tasks": lambda s, a: facts.tasks(_code(s, a), "path", "raw_code"),
    "edges": lambda s, a: facts.edges(_code(s, a), "path", "raw_code"),
    "structure": lambda s, a: flows.structures(_code(s, a), "path", "raw_code"),
    "validate-flows": lambda s, a: flows.checked(_code(s, a), "path", "raw_code"),
    "warn-flows": lambda s, a: flows.warned(_code(s, a), "path", "raw_code"),
    "file-lineage": lambda s, a: lineage.analysis(_code(s, a), "path", "path", "raw_code", not a.bare_names),
    "listing": lambda s, a: lineage.listing(lineage.analysis(_code(s, a), "path", "path", "raw_code", not a.bare_names), "path"),
    "upgrade": lambda s, a: migrate.migrate(_code(s, a), "path", "raw_code", a.version, a.dry_run),
    "upgrade-flows": lambda s, a: migrate.migrate_flows(_code(s, a), "path", "raw_code", a.dry_run),
    "upgrade-totals": lambda s, a: migrate.totals(migrate.migrate(_code(s, a), "path", "raw_code", a.version, True)),
    "rollback": lambda s, a: migrate.rollback_lines(migrate.migrate(_code(s, a), "path", "raw_code", a.version, False)),
    "lint-report": lambda s, a: validate.lint_summary(validate.lint_json(s.read.text(a.path, wholetext=True), "value")),
    "facts": lambda s, a: facts.facts(_code(s, a), "key", "raw_code"),
    "lint": _lint,
    "score": lambda s, a: validate.flow_score(validate.tally(_lint(s, a), "path")),
    "preview": lambda s, a: rewrite.fold(_code(s, a).select("path", "raw_code"), "raw_code").drop("raw_code"),
    "preview-flows": lambda s, a: rewrite.upgrade_flows(_code(s, a).select("path", "raw_code"), "raw_code").drop("raw_code"),
}


DEFAULTS = {"include": "*.py;*.sql;*.hql;*.sh", "exclude": "", "bare_names": False, "dry_run": False}


def _options(p: argparse.ArgumentParser, argv: list[str] | None) -> argparse.Namespace:
    """Options of the line over those of the settings file over the defaults."""
    told = vars(p.parse_args(argv))
    path = told["config"] or settings.find_upwards("loomwork.json", ".")
    merged = settings.merge(dict.fromkeys(told), DEFAULTS, settings.load(path) if path else None, told)
    return argparse.Namespace(**{k: merged.get(k) for k in told} | {k: v for k, v in merged.items() if k in told})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomwork", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--include")
    p.add_argument("--exclude")
    p.add_argument("--columns")
    p.add_argument("--where")
    p.add_argument("--bare-names", action="store_true", default=None)
    p.add_argument("--rules", help="a JSON or YAML file of classification rules")
    p.add_argument("--version", help="rewrite rules up to this version")
    p.add_argument("--dry-run", action="store_true", default=None)
    p.add_argument("--config", help="a JSON or YAML file of options; loomwork.json here or above by default. Options on the line hold over it")
    a = _options(p, argv)
    spark = SparkSession.getActiveSession() or local_session("loomwork")
    out = COMMANDS[a.command](spark, a)
    if a.out:
        out.write.mode("errorifexists").json(a.out)
    else:
        for line in out.limit(SHOWN).toJSON().collect():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
