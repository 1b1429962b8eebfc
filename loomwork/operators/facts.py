"""Facts from Python code by its syntax tree (read, never run): imports, calls, workflow tasks and edges."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DEPRECATED, FRAME_METHODS, RDD_METHODS
from ..session import stage

#: Calls that carry a task's command, and how deep names are followed (fixed values).
COMMAND_ARGS, DEEPEST = ("command", "bash_command", "python_callable", "application"), 10
FACTS = "key long, kind string, name string, detail string, line_no int"


def _tree(text: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, (ast.Attribute, ast.Call, ast.Subscript)):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        else:
            node = node.func if isinstance(node, ast.Call) else node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def resolve(node: ast.AST, names: dict[str, ast.AST], depth: int = 0) -> str:
    """The text of an expression: literals, names, +, %, f-strings and format; what is unknown stays as {name}."""
    if depth > DEEPEST:
        return "{...}"
    go = lambda n: resolve(n, names, depth + 1)
    if isinstance(node, ast.Constant):
        return str(node.value)
    if isinstance(node, ast.Name):
        return go(names[node.id]) if node.id in names else "{" + node.id + "}"
    if isinstance(node, ast.JoinedStr):
        return "".join(go(v.value) if isinstance(v, ast.FormattedValue) else go(v) for v in node.values)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return go(node.left) + go(node.right)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod):
        left = go(node.left)
        if isinstance(node.right, ast.Dict):
            for k, v in zip(node.right.keys, node.right.values, strict=True):
                left = re.sub(rf"%\({re.escape(go(k))}\)[sd]", lambda _, v=v: go(v), left)
            return left
        for v in node.right.elts if isinstance(node.right, ast.Tuple) else [node.right]:
            left = re.sub("%[sdr]", lambda _, v=v: go(v), left, count=1)
        return left
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
        text = go(node.func.value)
        for i, a in enumerate(node.args):
            text = text.replace("{" + str(i) + "}", go(a)).replace("{}", go(a), 1)
        for k in node.keywords:
            text = text.replace("{" + (k.arg or "") + "}", go(k.value))
        return text
    return "{" + (_dotted(node) or "unknown") + "}"


_INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|(?<![{$])\{([A-Za-z_]\w*)\}(?!\})")


def expand(text: str, names: dict[str, ast.AST], depth: int = 0) -> str:
    """``$v``, ``${v}`` and ``{v}`` inside a text replaced by the texts of the variables, also within those; others and ``{{ templates }}`` stay."""
    if depth >= DEEPEST:
        return text

    def value(m: re.Match) -> str:
        name = m[1] or m[2] or m[3]
        return expand(resolve(names[name], names), {k: v for k, v in names.items() if k != name}, depth + 1) if name in names else m[0]

    return _INSIDE.sub(value, text)


def _assigned(tree: ast.Module) -> dict[str, ast.AST]:
    return {t.id: n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}


def code_facts(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, detail, line): import, frame_op, rdd_op, config, deprecated, session, call."""
    tree, out = _tree(text), []
    if tree is None:
        return [("syntax_error", "", "", 0)]
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [("import", a.name, a.asname or "", n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [("import", n.module or "", a.name, n.lineno) for a in n.names]
        elif isinstance(n, ast.Call):
            name = _dotted(n.func)
            last = name.rsplit(".", 1)[-1]
            if not name:
                continue
            out.append(("call", name, "", n.lineno))
            if isinstance(n.func, ast.Attribute):
                text_join = isinstance(n.func.value, ast.Constant)
                if last in FRAME_METHODS:
                    out.append(("frame_op", last, "low" if text_join else "", n.lineno))
                if last in RDD_METHODS and (".rdd" in f".{name}" or last not in FRAME_METHODS):
                    out.append(("rdd_op", last, "", n.lineno))
                if name.endswith("conf.set") and n.args and isinstance(n.args[0], ast.Constant):
                    out.append(("config", str(n.args[0].value), "", n.lineno))
            out += [("deprecated", old, new, n.lineno) for old, new in DEPRECATED if f".{old}" in f".{name}"]
            if "SparkSession" in name:
                out.append(("session", name, "", n.lineno))
    return sorted(set(out), key=lambda r: (r[3], r[0], r[1], r[2]))


def facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per fact of each Python text (FACTS)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *f) for k, t in zip(b["k"], b["t"], strict=True) for f in code_facts(t)]
            yield pd.DataFrame(rows, columns=["key", "kind", "name", "detail", "line_no"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, FACTS)


# ---------------------------------------------------------------- workflows

_resolved = resolve


def _chain(node: ast.AST, edges: list, ids: dict[str, str]) -> list[str]:
    """Tasks at the end of a dependency expression; edges of the whole chain are added."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.RShift, ast.LShift)):
        left, right = _chain(node.left, edges, ids), _chain(node.right, edges, ids)
        for a in left:
            for b in right:
                edges.append((a, b, node.lineno) if isinstance(node.op, ast.RShift) else (b, a, node.lineno))
        return right
    if isinstance(node, (ast.List, ast.Tuple)):
        return [x for e in node.elts for x in _chain(e, edges, ids)]
    name = _dotted(node)
    return [ids.get(name, name)] if name else []


def flow(text: str) -> tuple[list[str], list[tuple], list[tuple]]:
    """(dag ids, tasks (task_id, operator, command, line), edges (upstream, downstream, line)) of a workflow definition."""
    tree = _tree(text)
    if tree is None:
        return [], [], []
    names, dags, tasks, ids, edges = _assigned(tree), [], [], {}, []
    resolve = lambda node, names: expand(_resolved(node, names), names)
    for n in ast.walk(tree):
        if not isinstance(n, ast.Call):
            continue
        cls, kw = _dotted(n.func).rsplit(".", 1)[-1], {k.arg: k.value for k in n.keywords if k.arg}
        if cls == "DAG":
            node = kw.get("dag_id", n.args[0] if n.args else None)
            dags.append((n.lineno, resolve(node, names) if node is not None else "unknown"))
        elif "task_id" in kw and (cls.endswith(("Operator", "Sensor")) or any(a in kw for a in COMMAND_ARGS)):
            command = next((resolve(kw[a], names) for a in COMMAND_ARGS if a in kw), "")
            tasks.append((resolve(kw["task_id"], names), cls, command, n.lineno))
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
            kw = {k.arg: k.value for k in n.value.keywords if k.arg}
            if "task_id" in kw:
                ids |= {t.id: resolve(kw["task_id"], names) for t in n.targets if isinstance(t, ast.Name)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Expr) and isinstance(n.value, ast.BinOp):
            _chain(n.value, edges, ids)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("set_upstream", "set_downstream") and n.args:
            own, other = _chain(n.func.value, [], ids), _chain(n.args[0], [], ids)
            edges += [(a, b, n.lineno) if n.func.attr == "set_downstream" else (b, a, n.lineno) for a in own for b in other]
    return [d for _, d in sorted(dags)], sorted(tasks, key=lambda t: t[3]), sorted(set(edges), key=lambda e: (e[2], e[0], e[1]))


def tasks(df: DataFrame, path: str, text: str) -> DataFrame:
    """dag_path, dag_file, dag_id (the first), dag_ids, task_id, operator, command, line_no, command_dir, command_file, kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["p"], b["t"], strict=True):
                dags, found, _ = flow(t)
                rows += [(p, dags[0] if dags else "unknown", dags, *x) for x in found]
            yield pd.DataFrame(rows, columns=["dag_path", "dag_id", "dag_ids", "task_id", "operator", "command", "line_no"])

    got = df.select(F.col(path).alias("p"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, "dag_path string, dag_id string, dag_ids array<string>, task_id string, operator string, command string, line_no int")
    return with_command(got, "command").withColumns({"dag_file": F.element_at(F.split("dag_path", "/"), -1), "kind": operator_kind("operator")})


def edges(df: DataFrame, path: str, text: str) -> DataFrame:
    """dag_path, upstream, downstream, line_no: every link of every chain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *e) for p, t in zip(b["p"], b["t"], strict=True) for e in flow(t)[2]]
            yield pd.DataFrame(rows, columns=["dag_path", "upstream", "downstream", "line_no"])

    return df.select(F.col(path).alias("p"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, "dag_path string, upstream string, downstream string, line_no int")


def with_command(df: DataFrame, command: str) -> DataFrame:
    """``df`` with command_dir (of the last ``cd``) and command_file (the last script); empty where there is none."""
    last = lambda p: F.coalesce(F.try_element_at(F.regexp_extract_all(command, F.lit(p), F.lit(1)), F.lit(-1)), F.lit(""))
    return df.withColumns({"command_dir": last(r"\bcd\s+([^\s;&|]+)"), "command_file": last(r"([^\s;&|'\"]+\.(?:py|sh))\b")})


def operator_kind(operator: str) -> F.Column:
    """The kind of an operator class; the first that fits."""
    out = None
    for kind, pattern in (("sensor", "Sensor"), ("python", "Python"), ("bash", "Bash"), ("sql", "(?i)sql|Hive|Presto|Trino|Postgres"), ("empty", "Dummy|Empty"), ("branch", "Branch"), ("trigger", "Trigger")):
        hit = F.col(operator).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def closure(df: DataFrame, upstream: str = "upstream", downstream: str = "downstream", by: str = "dag_path", most_rounds: int = 64) -> DataFrame:
    """All (by, upstream, downstream) linked directly or through others, within each ``by``.

    Each round joins the links found last with the direct ones and keeps the new
    pairs, so loops end and no path is followed twice. Rows with nulls take no
    part. Raises if links are chained further than ``most_rounds``.
    """
    direct = stage(df.select(F.col(by).alias("g"), F.col(upstream).alias("a"), F.col(downstream).alias("b")).dropna().distinct(), "links")
    known = last = direct
    for _ in range(most_rounds):
        step = last.join(direct.select("g", F.col("a").alias("b"), F.col("b").alias("c")), ["g", "b"]).select("g", "a", F.col("c").alias("b"))
        last = stage(step.distinct().join(known, ["g", "a", "b"], "left_anti"), "links")
        if last.isEmpty():
            return known.select(F.col("g").alias(by), F.col("a").alias(upstream), F.col("b").alias(downstream))
        known = known.union(last)
    raise RuntimeError(f"links are chained further than {most_rounds} rounds")
