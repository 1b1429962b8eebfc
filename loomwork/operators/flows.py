"""Workflow definitions by their syntax tree: structure, version, checks for an upgrade, warnings and requirements."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import BASE_REQUIREMENT, OLD_CONTEXT, OLD_MODULES, OLD_PARAMS, OLD_VERSION_MODULES, PROVIDERS, REMOVED_MODULES
from . import facts

STRUCTURE = "kind string, name string, detail string, line_no int"
CHECKS = "severity string, code string, detail string, line_no int"
_CONNECTION = re.compile(r"(?<![A-Za-z0-9])(?:\w+_)?conn_id\s*=\s*[\"']([^\"']+)[\"']")
_FLOW_ID = re.compile(r"dag_id\s*=\s*[\"']([^\"']+)[\"']")


def _last(node: ast.AST) -> str:
    return facts._dotted(node).rsplit(".", 1)[-1]


def _imports(tree: ast.AST) -> list[tuple[str, str, int]]:
    """(module, name imported from it or empty, line)."""
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(a.name, "", n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            out += [(n.module, a.name, n.lineno) for a in n.names]
    return out


def _decorators(tree: ast.AST) -> list[tuple[str, int, ast.AST]]:
    return [(_last(d), d.lineno, d) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for d in n.decorator_list]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def version_of(tree: ast.AST) -> str:
    """The version a definition is written for, as far as imports and decorators tell."""
    modules, made = {m for m, _, _ in _imports(tree)}, {d for d, _, _ in _decorators(tree)}
    if modules & set(OLD_VERSION_MODULES):
        return "2.x (deprecated imports)"
    if any("decorators" in m for m in modules) and made & {"dag", "task"}:
        scheduled = any(k.arg == "schedule" for n in ast.walk(tree) if isinstance(n, ast.Call) and _last(n.func) in ("DAG", "dag") for k in n.keywords)
        return "2.4+" if scheduled else "2.0+"
    return "2.x"


def structure(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, detail, line) of a definition, in order of lines.

    Kinds: import (name imported), operator (task id), config (parameter of the
    workflow: value), decorator, variable (read when the file is read),
    connection, hook, sensor, edge (upstream: downstream), version; or
    syntax_error alone.
    """
    tree = facts._tree(text)
    if tree is None:
        return [("syntax_error", "", "", 0)]
    names, out = facts._assigned(tree), []
    value = lambda n: facts.expand(facts.resolve(n, names), names) if not isinstance(n, (ast.Dict, ast.List, ast.Tuple, ast.Call)) else ast.unparse(n)
    out += [("import", m, n, line) for m, n, line in _imports(tree)]
    configs = [d for n, _, d in _decorators(tree) if n == "dag" and isinstance(d, ast.Call)]
    for n in ast.walk(tree):
        if not isinstance(n, ast.Call):
            continue
        cls, kw = _last(n.func), {k.arg: k.value for k in n.keywords if k.arg}
        if cls == "DAG":
            configs.append(n)
        if cls.endswith("Operator"):
            out.append(("operator", cls, value(kw["task_id"]) if "task_id" in kw else "", n.lineno))
        if "Sensor" in cls:
            out.append(("sensor", cls, value(kw["task_id"]) if "task_id" in kw else "", n.lineno))
        if "Hook" in cls:
            out.append(("hook", cls, "", n.lineno))
        if facts._dotted(n.func) == "Variable.get" and n.args and isinstance(n.args[0], ast.Constant):
            out.append(("variable", str(n.args[0].value), "", n.lineno))
    for c in configs:
        if c.args and _last(c.func) == "DAG":
            out.append(("config", "dag_id", value(c.args[0]), c.lineno))
        out += [("config", k.arg, value(k.value), k.value.lineno) for k in c.keywords if k.arg]
    out += [("decorator", d, "", line) for d, line, _ in _decorators(tree) if d]
    out += [("connection", m[1], "", _line(text, m.start())) for m in _CONNECTION.finditer(text)]
    out += [("edge", a, b, line) for a, b, line in facts.flow(text)[2]]
    out.append(("version", version_of(tree), "", 0))
    return sorted(set(out), key=lambda r: (r[3], r[0], r[1], r[2]))


def checks(text: str) -> list[tuple[str, str, str, int]]:
    """(severity, code, detail, line) of what hinders an upgrade; line 0 for the text as a whole.

    Six groups: syntax (alone, if it fails), imports, the definition and its id,
    operators, parameters, and the use of context, templates and time zones.
    """
    tree, out = facts._tree(text), []
    if tree is None:
        return [("error", "syntax", "", 0)]
    named = [x for m, n, line in _imports(tree) for x in ([(m, line), (f"{m}.{n}", line)] if n else [(m, line)])]
    for name, line in dict.fromkeys(named):
        out += [("error", "removed_import", name, line) for r in REMOVED_MODULES if r in name]
        if "airflow.contrib" in name:
            out.append(("error", "contrib_import", name, line))
        out += [("warning", "deprecated_import", name, line) for old, _ in OLD_MODULES if old in name]
    if not any(x in text for x in ("DAG(", "@dag", "with DAG")):
        out.append(("warning", "dag_definition", "", 0))
    out += [("warning", "dag_id_naming", m[1], _line(text, m.start())) for m in _FLOW_ID.finditer(text) if not re.fullmatch(r"[a-zA-Z][a-zA-Z0-9_-]*", m[1])]
    if "DummyOperator" in text and "EmptyOperator" not in text:
        out.append(("warning", "deprecated_operator", "DummyOperator", 0))
    if "SubDagOperator" in text:
        out.append(("error", "removed_operator", "SubDagOperator", 0))
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and "Operator" in _last(n.func) and not any(k.arg == "task_id" for k in n.keywords):
            out.append(("warning", "missing_task_id", _last(n.func), n.lineno))
    for param, severity, code in OLD_PARAMS:
        out += [(severity, code, param, _line(text, m.start())) for m in re.finditer(rf"\b{param}\s*=", text)]
    for key in OLD_CONTEXT:
        if f"context['{key}']" in text or f'context["{key}"]' in text:
            out.append(("warning", "context_key", key, 0))
        if re.search(rf"\{{\{{\s*{key}\s*\}}\}}", text):
            out.append(("warning", "jinja_template", key, 0))
    if "xcom_push" in text or "xcom_pull" in text:
        out.append(("info", "xcom_style", "", 0))
    if re.search("(?i)pendulum|timezone", text):
        out.append(("info", "timezone", "", 0))
    return sorted(out, key=lambda r: (r[3], r[1], r[2]))


def upgrade_warnings(text: str) -> list[tuple[str, str, str, int]]:
    """(severity, code, detail, line): what a rewrite cannot do and a person should look at."""
    tree, out = facts._tree(text), []
    if tree is None:
        return []
    out += [("warning", "subdag", _last(n.func), n.lineno) for n in ast.walk(tree) if isinstance(n, ast.Call) and "SubDag" in _last(n.func)]
    if "execution_date" in text:
        out.append(("warning", "execution_date", "", 0))
    if "xcom_push" in text or "xcom_pull" in text:
        out.append(("info", "xcom", "", 0))
    if any(k == "variable" for k, *_ in structure(text)):
        out.append(("info", "variable", "", 0))
    return sorted(out, key=lambda r: (r[3], r[1]))


def each(df: DataFrame, key: str, text: str, of: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """``key`` and the rows that ``of`` makes of each text; null texts have none."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b["k"], b["t"], strict=True) for r in of(t)], columns=["k", *columns])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def structures(df: DataFrame, key: str, text: str) -> DataFrame:
    return each(df, key, text, structure, STRUCTURE)


def checked(df: DataFrame, key: str, text: str) -> DataFrame:
    return each(df, key, text, checks, CHECKS)


def warned(df: DataFrame, key: str, text: str) -> DataFrame:
    return each(df, key, text, upgrade_warnings, CHECKS)


def requirements(modules: DataFrame, module: str) -> DataFrame:
    """requirement, ordinal: the base package, then the providers of the modules by name."""
    first = None
    for prefix, package in PROVIDERS:
        hit = F.col(module).startswith(prefix)
        first = F.when(hit, package) if first is None else first.when(hit, package)
    named = modules.select(first.alias("requirement")).filter("requirement is not null").distinct()
    base = modules.sparkSession.createDataFrame([(BASE_REQUIREMENT, 0)], "requirement string, part int")
    return base.union(named.withColumn("part", F.lit(1))).orderBy("part", "requirement").select("requirement", "part")
