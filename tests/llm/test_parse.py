from __future__ import annotations

import ast
import json
import random
import warnings
from pathlib import Path

import pytest
from loomwork.llm import p6_parse as P
from loomwork.llm.peg import Grammar, Token

PYTHON = [
    "", "x = 1\n", "if x:\n  pass\nelse:\n\ty()\n", "def f(a, *b, c=1, **d) -> int: return a\n", "async def f():\n    async with a as b, c: await d\n",
    "@dec(1)\nclass A(B, metaclass=C):\n    x: int = 1\n    def f(self): ...\n", "x = [i for i in y if i for j in z]\n", "print(f\"{a!r:>{w}} {b['k']}\")\n",
    "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c} | A(z=1): pass\n    case _: pass\n", "a = b = (yield)\n", "lambda *a, k=1: (a, k)\n",
    "x = y if z else w\nx += 1; y **= 2\n", "try:\n  a\nexcept* (E, F) as e:\n  b\nfinally:\n  c\n", "del a[0], b.c\n", "with (a as b, c as d): pass\n",
    "for x, *y in z: pass\nelse: q()\n", "x = {**a, 'b': 1}; y = {1, *z}\n", "global a\n", "from . import (a as b, c,)\n", "while (n := f()) > 1: break\n", "x[1:2, ::3, ...] = 4\n",
    "def f[T: int](x: T): pass\ntype A[T] = list[T]\n", "'''a\nb''' \"c\"\n", "not a is not b\n",
    "f(**a, b)\n", "f(*a, b=1, **c)\n", "f(a=1, 2)\n", "f(**a, *b)\n", "f'{'\n", "def f(a=1, b): pass\n", "f(a=1, *b)\n", "f(x for x in y)\n", "f(x for x in y, 1)\n", "f((a)=1)\n", "f(True=1)\n",
]
FORMATTED = r"""f'{x!r:>{w}.{p}}' f'{x!q}' f'}' f'{{}}' f'{{{x}}}' f'{}' f'{x:{y}' f'{x' f'{a["b"]}' f'{a['b']}' f"{f'{f"{1}"}'}" f'{x=}' f'{x=!r}' f'{(lambda:1)()}' f'{lambda:1}' f'{x!=y}' f'{x:=10}' f'{(x:=10)}'
f'\N{DASH}' f'\N{EM_DASH}' rf'\{x}\d' f'\{x}' f'{yield}' f'{*a,b}' f'{{1:2}[1]}' 'a'b'c' b'c''a' b'c'b'd' b'é' '\x1' '\xff' r'\x1' b'\x1' b'\u1' '\u12' '\N{nope}' '\U00110000' '\U0010ffff' f'{"\n".join(x)}' f'{x#}'""".split()
PARAMS = ["a, /, b, *, c, **d", "a, b=1, /, c=2, *d, e, f=1, **g", "a, b=1, /, c", "/, a", "*, a", "*", "*, **k", "*,", "**k, a", "**k,", "*a, *b", "a, *, b=1, c", "a=1, b", ""]
BROKEN = ["x = = 1\n", "if x\n  pass\n", "def f(:\n", "x = (1\n", "'abc\n", "  x = 1\n", "if x:\npass\n", "f() = 1\n", "a + b = 2\n", "print 'x'\n", "x = 1 +\n", "class\n", "'''open\n", "x = 12ab\n", "<<<<<<< a\n", "try:\n  a\n", "for in x: pass\n", "x = [1, 2\n", "import\n", "x = $\n", "def f():\n    x\n  y\n", "else: x\n"]


def python_ok(t):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(t)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize("t", PYTHON + BROKEN + [f"{x}\n" for x in FORMATTED] + [f"def f({x}): pass\n" for x in PARAMS] + [f"lambda {x}: 0\n" for x in PARAMS])
def test_python_as_the_interpreter(t):
    assert P.check(t, "python").valid == python_ok(t)


def test_python_files_and_their_damaged_forms():
    rnd = random.Random(3)
    for p in sorted((Path(__file__).parents[2] / "loomwork").rglob("*.py")):
        text = p.read_text()
        assert P.check(text, "python").valid, p
        for _ in range(6):
            cut = text[: rnd.randrange(len(text) + 1)]
            assert P.check(cut, "python").valid == python_ok(cut), (p, len(cut))


@pytest.mark.parametrize("t", ["{}", "[1, -2.5e3, null]", '{"a": [true, {"b": "\\u00e9"}]}', "3", "", " ", "{'a': 1}", "[1,]", '{"a" 1}', "[1] x", "01", '"a\nb"', "nul", "[", '{"a": "x'])
def test_json(t):
    try:
        json.loads(t)
        ok = True
    except ValueError:
        ok = False
    assert P.check(t, "json").valid == ok


SQL_GOOD = [
    "", ";", "-- only a remark\n", "select 1", "SELECT a.b, count(DISTINCT c) AS n, 'it''s' FROM x.y a LEFT OUTER JOIN z ON a.k = z.k AND z.d BETWEEN 1 AND 2 WHERE a.v NOT IN (1, 2) GROUP BY a.b HAVING count(*) > 1 ORDER BY n DESC NULLS LAST LIMIT 10;",
    "INSERT OVERWRITE TABLE a.b PARTITION (dt='${day}') SELECT * FROM c", "with a as (select 1), b as (select 2 from a) select * from a union all select * from b",
    "CREATE TABLE IF NOT EXISTS a.b (x BIGINT COMMENT 'c', y MAP<STRING, ARRAY<STRUCT<p:INT, q:DECIMAL(10,2)>>>) PARTITIONED BY (dt STRING) STORED AS ORC TBLPROPERTIES ('a'='b');",
    "select sum(a) over (partition by b order by c rows between unbounded preceding and current row) from t", "select case when a then 1 else 2 end, cast(b as decimal(10,2)), a[0].b, interval 5 minutes from t lateral view explode(x) e as y",
    "MSCK REPAIR TABLE a.b; SET hive.x.y=true; REFRESH a.b; ANALYZE TABLE a COMPUTE STATISTICS; DROP TABLE IF EXISTS a;", "merge into t using s on t.a = s.a when matched then update set b = s.b when not matched then insert (a) values (s.a)",
    "CREATE TABLE a USING jdbc OPTIONS (url 'x', user 'y')", "create or replace view v as select 1", "select * from (values (1, 'a'), (2, 'b')) t(x, y)", "delete from t where a is not null", "select `odd name` from `t` where x rlike '^a' and y is distinct from z",
]
SQL_BAD = ["select", "select a from", "select a, from t", "select a from t where", "insert into", "create table a (x int", "select 'open", "select a from t group", "<<<<<<< HEAD\nselect 1", "def f(): pass", "select case when a then 1 from t", "select (a from t", "/* open", "select a from t join", "select count( from t", "with a as (select 1)"]


@pytest.mark.parametrize("t", SQL_GOOD)
def test_sql_valid(t):
    assert P.check(t, "sql") == P.Verdict(True)


@pytest.mark.parametrize("t", SQL_BAD)
def test_sql_invalid(t):
    assert not P.check(t, "sql").valid


SH_GOOD = [
    "", "#!/bin/bash\n# x\n", "a=1 b=$(c \"d $(e)\") f | g && h || i &\n", "if [ -f x ]; then\n  y\nelif z; then w; else v; fi\n", "for p in a b; do echo $p; done\nwhile true; do break; done\n", "case $x in a|b) y ;; *) z ;; esac\n",
    "f() {\n  local a=(1 2 3)\n  return 1\n}\nf\n", "cat <<EOF | sort\n<<<<<<< not a conflict\n$x ' \"\nEOF\n", "x=${a:-b}; [[ $x == a* && -n $y ]] || exit 1\n", "(cd a; ls) > out 2>&1 < in\n", "((i++)); for ((i=0;i<3;i++)); do :; done\n", "echo 'a\nb' `c` $((1 + (2)))\n", "until a; do b; done &> x\n", "! a\n", "cat <<'A' <<-B\nx\nA\n\ty\n\tB\n",
]
SH_BAD = ["if a; then b\n", "for x in a; do b\n", "echo 'open\n", 'echo "open\n', "f() {\n a\n", "case x in a) b ;;\n", "a )\n", "fi\n", "log = f(x)\n", "<<<<<<< HEAD\na\n", "echo $(a\n", "cat <<EOF\nx\n", "a | | b\n", "then\n", "a &&\n"]


@pytest.mark.parametrize("t", SH_GOOD)
def test_shell_valid(t):
    assert P.check(t, "shell") == P.Verdict(True)


@pytest.mark.parametrize("t", SH_BAD)
def test_shell_invalid(t):
    assert not P.check(t, "shell").valid


UTILITY_GOOD = [
    "ALTER TABLE a.b ADD IF NOT EXISTS PARTITION (dt='1') LOCATION '/x' PARTITION (dt='2')", "alter table t add columns (a int comment 'x', b map<string,array<int>>) cascade", "alter table t drop if exists partition (dt < '2'), partition (dt = '3') purge", "alter table t change a b bigint comment 'c' after d",
    "ALTER TABLE t SET TBLPROPERTIES ('a'='b'); alter table t rename to u; alter table t partition (dt='1') set location '/x'; alter table t alter column c type bigint", "ALTER USER u SET PASSWORD = 'x'; CREATE USER u IDENTIFIED BY 'x'; create user v identified by {{ pw }}; create role r", "drop view if exists v; drop database d cascade; DROP FUNCTION f; truncate table t partition (dt='1')",
    "GRANT SELECT, INSERT ON TABLE a.b TO ROLE r WITH GRANT OPTION; revoke all privileges on database d from user u; grant role r to u", "ANALYZE TABLE t PARTITION (dt='1') COMPUTE STATISTICS FOR COLUMNS a, b; compute incremental stats t; COMPUTE STATS t", "LOAD DATA LOCAL INPATH '/x' OVERWRITE INTO TABLE t PARTITION (dt='1')",
    "create database if not exists d comment 'x' location '/y'; create function f as 'a.B' using jar 'hdfs:///x.jar'; create temporary function g as 'C'; create macro m(x int) x + 1", "import table t from '/x'; export table t to '/x'; add jar /a/b-1.jar; list jars; source /a/b.hql; comment on table t is 'x'", "describe formatted a.b; desc t; explain select 1; show partitions t; show create table t; show tables; show tables in d like 'x*'; use d",
    "show role grant user u; show current roles; show functions like 'x*'; show grant user u on table t; show locks t; show databases; show conf 'x'",
    "CACHE TABLE t; REFRESH TABLE t; INVALIDATE METADATA; copy into t from 's3://x' credentials 'a=b' fileformat = csv; set; reset; begin; commit",
]
UTILITY_BAD = [
    "ALTER TABLE t ADD", "alter table t", "alter table t add columns (a", "alter table t add partition", "alter table t rename to", "alter user u set password", "alter user u set password =", "drop table", "drop table if exists", "truncate table", "grant select on t", "grant select on table t to", "analyze table t", "analyze table t compute", "msck repair table", "msck",
    "load data inpath '/x' into table", "create database", "create function f", "create user u identified by", "import os\nimport sys\nprint(sys.argv)\n", "import os", "explain", "explain nonsense words", "show partitions", "describe", "comment on table t is", "list of things", "copy into t from", "purge it", "use",
    "show me the money", "grant banana 1 2 3", "drop table select from where", "load data inpaht 'x' imto table t", "truncate tabel t", "use , , ,", "show",
    "alter table t\n<<<<<<< HEAD\nadd columns (a int)\n=======\nadd columns (b int)\n>>>>>>> x\n", "set x y\n<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n",
]
BODIES_GOOD = ["x=$(if a; then b; fi)\n", 'echo "$(a "$(b | c)") `d \\`e\\``"\n', "a=(1 '2' \"$(x y)\"\n  3 # r\n)\n", "diff <(a | b) <(c)\n", "x=$(( $(a) + (2) )); y=${z:-$(b)}\n", "x=$(<f); y=$(); z=$(\n# r\na\n)\n", "echo '$(if)' \"it's $(a)\"\n"]
BODIES_BAD = ["x=$(if true)\n", 'echo "$(for x in a; do b)"\n', "x=`if a`\n", "diff <(a |) b\n", "x=${y:-$(a | | b)}\n", "a=(1 | 2)\n", "x=$(( $(fi) + 1 ))\n", 'x="$(a "$(then)")"\n', "a=($(if b))\n"]


@pytest.mark.parametrize("t", UTILITY_GOOD)
def test_sql_utility_valid(t):
    assert P.check(t, "sql") == P.Verdict(True)


@pytest.mark.parametrize("t", UTILITY_BAD)
def test_sql_utility_invalid(t):
    assert not P.check(t, "sql").valid


@pytest.mark.parametrize(("t", "ok"), [*((t, True) for t in BODIES_GOOD), *((t, False) for t in BODIES_BAD)])
def test_shell_bodies(t, ok):
    assert P.check(t, "shell").valid == ok


def test_place_and_cause():
    v = P.check("x = 1\n<<<<<<< a\ny = 2\n=======\ny = 3\n>>>>>>> b\n", "python")
    assert (v.cause, v.line_no) == ("merge conflict", 2)
    assert P.check("x = (1,\n  2", "python").cause == "cut off" and P.check("select a from t where", "sql").cause == "cut off"
    assert P.check('{"a": 1}', "sql").cause == "wrong extension" and P.check('{"a": 1}', "sql").detail == "valid json"
    v = P.check("x = 1\ny = = 2\n", "python")
    assert (v.line_no, v.column_no, v.cause) == (2, 5, "syntax")


def test_grammar_compiler():
    g = Grammar("s <- a+ !B EOF\na <- 'x' ('y' / 'z')? &('x' / EOF)")
    toks = lambda s: [*(Token("W", c, i) for i, c in enumerate(s)), Token("EOF", "", len(s))]
    assert [g.accepts(toks(s)) for s in ("x", "xyxzx", "", "xx", "xyy", "y")] == [True, True, False, True, False, False]
    assert g.furthest(toks("xyq"))[0] == 2
    with pytest.raises(ValueError, match="no rule"):
        Grammar("s <- nothing")


def test_deep_nesting_and_long_texts():
    assert P.check("(" * 3000 + ")" * 3000 + "\n", "python").valid
    assert P.check("x = 1\n" * 20_000, "python").valid
    assert P.check("[" * 20_000, "json").valid is False
    assert P.check("[" * 100_000 + "]" * 100_000, "json").valid  # nesting has no limit
    assert P.check("select " + "(" * 5000 + "1" + ")" * 5000, "sql").valid


def test_frames(spark):
    rows = [(1, "/srv/git/r/a.py", 7, "x = 1\n"), (2, "/srv/git/r/b.PY", None, "x = ("), (3, "/x/c.sql", None, None), (4, "/srv/git/r/d.json", 7, ""), (5, "e.txt", 1, "?")]
    files = spark.createDataFrame(rows, "file_id long, file_path string, repo_id int, raw_code string").selectExpr("*", "1 AS valid")
    hints = spark.createDataFrame([("/srv/git/r/b.PY", ["e"]), ("/srv/git/r/b.PY", None)], "file_path string, errors array<string>")
    got = {r.file_id: r for r in P.parse_files(files, hints).collect()}
    assert set(got) == {1, 2, 4} and [got[i].valid for i in (1, 2, 4)] == [True, False, False] and got[2].hinted and got[2].repo == "r"
    rates = {(r.repo, r.language): r.rate for r in P.rates(P.parse_files(files)).collect()}
    assert rates == {("7", "python"): 0.0, ("r", "python"): 1.0, ("7", "json"): 1.0}
    assert P.parse_files(files.limit(0)).count() == 0
