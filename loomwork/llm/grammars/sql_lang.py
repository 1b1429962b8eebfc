"""SQL of the warehouse engines (Hive, Spark, Impala, Presto), as scripts of statements."""

from __future__ import annotations

import re

from ..peg import Grammar, LexError, Token

#: Words that are names only in quotes (fixed values).
RESERVED = frozenset(
    """select from where group having order by on using join inner left right full cross outer semi anti union intersect except minus
    all distinct as and or not in is null like rlike regexp ilike between case when then else end exists insert into overwrite create drop alter
    table with limit lateral set values cast interval true false qualify""".split()
)
GRAMMAR = Grammar("""
script <- ';'* (statement (';'+ / &EOF))* EOF
statement <- explain? (query_statement / insert / create / merge / update / delete / utility / SETTING)
%explain <- 'explain' ('extended' / 'formatted' / 'codegen' / 'cost' / 'analyze' !'table' / 'logical' / 'dependency' / 'authorization' / 'locks' / 'ast' / 'cbo' / 'verbose' / 'vectorization' 'only'? ('summary' / 'operator' / 'expression' / 'detail')? / '(' rest ')')*

query_statement <- query / with? 'from' relation lateral* (insert_head select_tail_first / select_tail_first)+
%select_tail_first <- 'select' select_body
query <- with? term (setop term)* tail*
%with <- 'with' 'recursive'? cte (',' cte)*
cte <- ident ('(' ident (',' ident)* ')')? 'as' ('not'? 'materialized')? '(' query ')'
%setop <- ('union' / 'intersect' / 'except' / 'minus') ('all' / 'distinct')?
term <- select / '(' query ')' / values / 'table' qname
select <- 'select' select_body
select_body <- ('distinct' / 'all')? item (',' item)* ('from' relation (',' relation)* )? lateral* clause*
%clause <- 'where' expr / 'group' 'by' group_items ('with' ('rollup' / 'cube') / grouping_sets)? / 'having' expr / 'qualify' expr / 'window' named_window (',' named_window)*
%group_items <- 'all' / group_item (',' group_item)*
%group_item <- ('rollup' / 'cube') '(' exprs ')' / grouping_sets / '(' ')' / expr
%grouping_sets <- 'grouping' 'sets' '(' ('(' exprs? ')' / expr) (',' ('(' exprs? ')' / expr))* ')'
%named_window <- ident 'as' '(' window_spec ')'
%tail <- ('order' / 'sort') 'by' sort_item (',' sort_item)* / ('distribute' / 'cluster') 'by' expr (',' expr)* / 'limit' ('all' / expr (',' expr)?) / 'offset' expr ('rows' / 'row')? / 'fetch' ('first' / 'next') expr? ('rows' / 'row') 'only'
%sort_item <- expr ('asc' / 'desc')? ('nulls' ('first' / 'last'))?
item <- star / expr alias?
%star <- (ident '.')* '*' ('except' '(' ident (',' ident)* ')')?
%alias <- 'as' (ident / STRING / '(' ident (',' ident)* ')') / ident
relation <- primary_relation joined*
%joined <- (join_kind? 'join' primary_relation on?) / lateral
%join_kind <- 'inner' / 'cross' / 'natural'? ('left' / 'right' / 'full') ('outer' / 'semi' / 'anti')? / 'semi' / 'anti' / 'natural'
%on <- 'on' expr / 'using' '(' ident (',' ident)* ')'
primary_relation <- 'lateral'? '(' query ')' sample? relation_alias? / '(' relation ')' relation_alias? / values relation_alias? / ident '(' exprs? ')' relation_alias? / ('unnest' / 'table') '(' exprs ')' relation_alias? / qname sample? relation_alias?
%sample <- 'tablesample' '(' balanced ')'
%relation_alias <- 'as'? !join_word ident ('(' ident (',' ident)* ')')?
%join_word <- 'natural' / 'window' / 'fetch' / 'offset' / 'sort' / 'cluster' / 'distribute' / 'tablesample'
lateral <- 'lateral' 'view' 'outer'? qname '(' exprs? ')' ident? ('as' ident (',' ident)*)?
values <- 'values' value_row (',' value_row)*
%value_row <- '(' exprs ')' / expr

exprs <- expr (',' expr)*
expr <- inversion (('and' / 'or') inversion)*
inversion <- ('not' / '!')* predicate
predicate <- 'exists' '(' query ')' / sum check*
%check <- ('=' / '==' / '<>' / '!=' / '<=>' / '<=' / '>=' / '<' / '>') (('all' / 'any' / 'some') '(' query ')' / sum)
  / 'is' 'not'? ('null' / 'true' / 'false' / 'unknown' / 'distinct' 'from' sum)
  / 'not'? 'between' sum 'and' sum / 'not'? 'in' ('(' query ')' / '(' exprs ')' / VARIABLE)
  / 'not'? ('like' / 'rlike' / 'regexp' / 'ilike') ('any' / 'all')? sum ('escape' STRING)?
sum <- unary (binary unary)*
%binary <- '+' / '-' / '*' / '/' / '%' / '||' / '&' / '|' / '^' / 'div' / 'mod' / '->' / '=>' / '>' '>' / '<' '<'
%unary <- ('-' / '+' / '~')* postfix
postfix <- atom ('[' expr ']' / '.' ident / '::' type / 'over' window)*
atom <- STRING+ / NUMBER unit? / 'null' / 'true' / 'false' / case / cast / interval / typed / function / column / VARIABLE / '(' query ')' / '(' exprs ')' / '?' / ':' ident / '*' &')'
%unit <- 'k' / 'm' / 'g'
case <- 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end'
cast <- ('cast' / 'try_cast') '(' expr 'as' type ')'
interval <- 'interval' (STRING / '-'? NUMBER / '(' expr ')' / column) ident? ('to' ident)?
%typed <- ('date' / 'timestamp' / 'binary') STRING
function <- function_name '(' ('distinct' / 'all')? arguments? ')' ('within' 'group' '(' 'order' 'by' sort_item (',' sort_item)* ')')? ('filter' '(' 'where' expr ')')? ('ignore' 'nulls' / 'respect' 'nulls')?
%function_name <- qname / 'left' / 'right' / 'insert' / 'values' / 'set'
arguments <- '*' / argument (',' argument)* ('order' 'by' sort_item (',' sort_item)*)?
%argument <- query / ('both' / 'leading' / 'trailing')? expr ('from' expr ('for' expr)?)? ('as' (ident / type))? / ('both' / 'leading' / 'trailing') 'from' expr
window <- ident / '(' window_spec ')'
%window_word <- 'partition' / 'distribute' / 'sort' / 'rows' / 'range' / 'groups'
%window_spec <- (!window_word ident)? ('partition' 'by' exprs)? ('distribute' 'by' exprs)? (('order' / 'sort') 'by' sort_item (',' sort_item)*)? frame?
%frame <- ('rows' / 'range' / 'groups') ('between' bound 'and' bound / bound)
%bound <- 'unbounded' ('preceding' / 'following') / 'current' 'row' / expr ('preceding' / 'following')
%column <- qname
qname <- ident ('.' ident)*
%ident <- NAME / QUOTED_NAME / VARIABLE
type <- ('array' '<' type '>' / 'map' '<' type ',' type '>' / ('struct' / 'row') ('<' field (',' field)* '>' / '(' field (',' field)* ')') / 'double' 'precision' / NAME type_size?) ('with' ident 'time' 'zone')? ('[' ']')?
%type_size <- '(' (NUMBER / NAME) (',' NUMBER)* ')'
%field <- ident ':'? type ('not' 'null')? ('comment' STRING)?

insert <- with? insert_head (query / values_source)
%values_source <- values
%insert_head <- 'insert' ('overwrite' 'local'? 'directory' STRING directory_clause* / ('into' / 'overwrite') 'table'? qname partition? ('if' 'not' 'exists')? ('(' ident (',' ident)* ')')?)
%directory_clause <- row_format / 'stored' 'as' ident / 'using' ident / 'options' properties
%partition <- 'partition' '(' partition_item (',' partition_item)* ')'
%partition_item <- ident ('=' expr)?
create <- 'create' ('or' 'replace')? create_word* (create_table / create_view / create_other)
%create_word <- 'external' / 'temporary' / 'temp' / 'global' / 'transactional' / 'managed' / 'materialized' / 'unlogged'
%create_table <- 'table' ('if' 'not' 'exists')? qname (('(' column_def (',' column_def)* ')')? table_clause* ('as'? query table_clause*)? )
%create_view <- 'view' ('if' 'not' 'exists')? qname ('(' view_column (',' view_column)* ')')? table_clause* 'as' query
%view_column <- ident ('comment' STRING)?
%create_other <- ('database' / 'schema' / 'catalog') if_not? qname database_clause* / 'aggregate'? 'function' if_not? qname ('(' rest? ')')? function_clause+ / 'macro' qname '(' (field (',' field)*)? ')' expr / ('user' / 'role' / 'login') if_not? user_name user_option* / ('index' / 'server' / 'procedure') if_not? qname rest
%if_not <- 'if' 'not' 'exists'
%if_exists <- 'if' 'exists'
%database_clause <- ('comment' / 'location' / 'managedlocation') path / 'with' 'dbproperties'? properties / 'authorization' user_name / 'using' qname
%function_clause <- 'as' (STRING / query / expr) / 'using' resource (',' resource)* / 'location' path / 'returns' ('table' ('(' rest ')')? / type) / 'return' (query / expr) / 'language' ident / 'comment' STRING / ident '=' value / 'not'? 'deterministic'
%resource <- ('jar' / 'file' / 'archive') path
%user_name <- ident / STRING
%user_option <- 'identified' ('with' user_name)? 'by' 'password'? value / ('set' / 'with' / 'encrypted')* 'password' '='? value / 'superuser' / 'nosuperuser' / 'createdb' / 'nologin' / 'set'? 'default'? ident '='? value
%value <- STRING / NUMBER / ident / 'true' / 'false' / 'null'
%path <- STRING / VARIABLE
%names <- ident (',' ident)*
column_def <- constraint / ident ':'? type column_option*
%column_option <- 'not'? 'null' / 'comment' STRING / 'default' sum / 'primary' 'key' / 'unique' / 'references' balanced_until / 'check' '(' expr ')' / 'generated' 'always' 'as' '(' expr ')' / 'encoding' ident / ('disable' / 'enable') ('novalidate' / 'validate')? 'rely'? / 'auto_increment'
%balanced_until <- qname ('(' ident (',' ident)* ')')?
%constraint <- ('constraint' ident)? ('primary' 'key' '(' ident (',' ident)* ')' ('not' 'enforced')? ('disable' 'novalidate'? 'rely'?)? / 'unique' 'key'? ident? '(' ident (',' ident)* ')' / 'foreign' 'key' '(' ident (',' ident)* ')' 'references' balanced_until / 'key' ident '(' ident (',' ident)* ')' / 'check' '(' expr ')' / 'watermark' 'for' ident 'as' expr)
%table_clause <- 'comment' '='? STRING / 'partitioned' ('by' / 'on') '(' partition_def (',' partition_def)* ')' / 'partition' 'by' '(' exprs ')' / 'clustered' 'by' '(' ident (',' ident)* ')' ('sorted' 'by' '(' sort_item (',' sort_item)* ')')? ('into' NUMBER 'buckets')?
  / 'sort' 'by' '(' ident (',' ident)* ')' / 'skewed' 'by' balanced_until 'on' '(' balanced ')' / row_format / 'stored' ('as' ('directories' / 'inputformat' STRING 'outputformat' STRING / ident) / 'by' STRING) / 'location' STRING / ('tblproperties' / 'options' / 'properties') properties / 'with' properties / 'using' qname / 'like' qname / ('engine' / 'charset') '=' ident / 'default' 'charset' '=' ident / 'cached' 'in' STRING
%partition_def <- ident type ('comment' STRING)? / expr
%row_format <- 'row' 'format' ('serde' STRING ('with' 'serdeproperties' properties)? / 'delimited' delimited*)
%delimited <- 'fields' 'terminated' 'by' STRING ('escaped' 'by' STRING)? / 'collection' 'items' 'terminated' 'by' STRING / 'map' 'keys' 'terminated' 'by' STRING / 'lines' 'terminated' 'by' STRING / 'null' 'defined' 'as' STRING
%properties <- '(' property (',' property)* ')'
%property <- (STRING / ident ('.' ident / '-' ident)*) ('='? (STRING / NUMBER / '-' NUMBER / 'true' / 'false' / ident))?
merge <- with? 'merge' 'into' qname relation_alias? 'using' primary_relation 'on' expr merge_when+
%merge_when <- 'when' 'not'? 'matched' ('by' ('source' / 'target'))? ('and' expr)? 'then' ('delete' / 'update' 'set' ('*' / assign (',' assign)*) / 'insert' ('*' / ('(' qname (',' qname)* ')')? 'values' '(' exprs ')'))
%assign <- qname '=' ('default' / expr)
update <- with? 'update' qname relation_alias? 'set' assign (',' assign)* ('from' relation)? ('where' expr)?
delete <- with? 'delete' 'from' qname relation_alias? ('using' relation)? ('where' expr)?
utility <- drop / alter / truncate / 'set' rest? / 'use' (('catalog' / 'schema' / 'database') qname / qname) / 'show' show / ('describe' / 'desc') describe_word* (query / qname partition? qname? / STRING) / ('msck' 'repair'? / 'repair') 'table' qname (('add' / 'drop' / 'sync') 'partitions')?
  / 'refresh' ('table' qname / ('function' / 'functions' / 'materialized' 'view') qname / STRING / qname partition*) / 'invalidate' 'metadata' qname? / 'analyze' analyze / 'compute' 'incremental'? 'stats' qname (partition_filter / '(' names ')')? sample? / 'load' 'data' 'local'? 'inpath' path 'overwrite'? 'into' 'table' qname partition? ('inputformat' STRING 'serde' STRING)?
  / 'grant' privilege (',' privilege)* ('on' object (',' object)*)? 'to' grantee (',' grantee)* ('with' ('grant' / 'admin') 'option')? / 'revoke' (('grant' / 'admin') 'option' 'for')? privilege (',' privilege)* ('on' object (',' object)*)? 'from' grantee (',' grantee)*
  / 'cache' 'lazy'? 'table' qname ('options' properties)? ('as'? query)? / 'uncache' 'table' if_exists? qname / 'clear' 'cache' / ('add' / 'delete') files words / 'list' files words? / 'reset' words? / 'unset' words / ('source' / 'dfs') words
  / 'export' 'table' qname partition? 'to' path ('for' rest)? / 'import' ('external'? 'table' qname partition?)? 'from' path ('location' path)? / 'copy' 'into'? (qname ('(' names ')')? / STRING) 'from' (STRING / VARIABLE / '(' query ')' / qname) rest? / 'call' qname '(' arguments? ')' / 'optimize' 'table'? qname rest? / 'vacuum' 'table'? (qname / STRING) rest?
  / 'comment' 'on' ('table' / 'column' / 'view' / 'database' / 'schema' / 'role' / 'materialized' 'view' / 'function') qname 'is' (STRING / 'null') / 'lock' ('table' / 'tables' / 'database') qname partition? rest? / 'unlock' ('table' / 'tables' / 'database') (qname partition?)? / 'reload' ('function' / 'functions') / 'begin' ('transaction' / 'work')? / ('commit' / 'rollback') ('transaction' / 'work')? / 'start' 'transaction' rest?
  / 'declare' ('or' 'replace')? 'variable'? declared / 'restore' 'table'? qname 'to' rest / 'kill' 'query' STRING (',' STRING)* / 'prepare' ident 'from' statement / 'execute' ('immediate' rest / ident ('using' exprs)?) / 'deallocate' 'prepare' ident
%declared <- ident (('default' / '=') expr / type (('default' / '=') expr)?)
%show <- 'create' ('table' / 'view' / 'schema' / 'database' / 'function' / 'materialized' 'view') qname ('as' 'serde')? / ('partitions' / 'tblproperties') qname rest? / 'columns' ('from' / 'in') qname rest? / 'table' ('extended' rest / 'stats' qname) / 'column' 'stats' qname / 'files' 'in' qname partition? / show_kind rest?
%show_kind <- 'tables' / 'views' / 'materialized' 'views' / 'databases' / 'schemas' / 'namespaces' / 'catalogs' / ('all' / 'user' / 'system')? 'functions' / 'current'? 'roles' / 'role' 'grant' / 'grant' / 'grants' / 'principals' / 'users' / 'locks' / 'transactions' / 'compactions' / 'connectors' / 'conf' / 'formatted'? ('index' / 'indexes') / 'session' / 'variables' / 'global' ('variables' / 'status') / 'status' / 'full'? 'processlist' / 'procedures' / 'stats' / 'range' 'partitions' / 'data' 'sources' / 'collation' / 'warnings' / 'errors' / 'engines' / 'keys' / 'triggers' / 'resource' 'plans' / 'resource' 'plan' / 'current' ('user' / 'schema' / 'catalog') / 'authors' / 'backups' / 'profiles' / 'queries'
%describe_word <- ('extended' / 'formatted' / 'database' / 'schema' / 'catalog' / 'function' / 'table' / 'query' / 'history' / 'detail' / 'input' / 'output') &(NAME / QUOTED_NAME / VARIABLE / STRING / 'table' / 'select' / 'with' / 'values' / 'from' / '(')
%analyze <- 'table' qname partition_filter? 'compute' 'statistics' ('for' ('all'? 'columns' names? / names) / 'noscan' / 'partialscan' / 'cache' 'metadata')* / 'tables' (('in' / 'from') qname)? 'compute' 'statistics' 'noscan'? / qname ('with' properties)?
%files <- 'jar' / 'jars' / 'file' / 'files' / 'archive' / 'archives'
%privilege <- (!('on' / 'to' / 'from') (NAME / KEY / QUOTED_NAME / VARIABLE))+ ('(' names ')')?
%object <- 'all' ident 'in' ident star_name / ('table' / 'values' / NAME) star_name / star_name
%star_name <- STRING / '*' ('.' '*')? / ident ('.' (ident / '*'))*
%grantee <- ('user' / 'role' / 'group' / 'share') user_name / user_name ('identified' 'by' value)?
drop <- 'drop' ('temporary' / 'temp')? ('table' / 'materialized'? 'view' / 'aggregate'? 'function' / 'macro' / 'database' / 'schema' / 'catalog' / 'user' / 'role' / 'index' / 'incremental'? 'stats' / 'procedure' / 'server' / 'login' / 'connector') if_exists? drop_name (',' drop_name)* ('(' rest? ')')? partition_filter? ('on' qname)? ('cascade' / 'restrict' / 'purge' / 'force')*
%drop_name <- qname / STRING
truncate <- 'truncate' 'table'? if_exists? qname partition? ('columns' '(' names ')')? 'force'?
alter <- 'alter' ('table' if_exists? qname partition? alter_action (','? alter_action)* / 'materialized'? 'view' if_exists? qname ('as'? query / ('enable' / 'disable') 'rewrite' / 'rebuild' / alter_action) / ('database' / 'schema' / 'catalog') qname alter_action / ('user' / 'role' / 'login') user_name ('rename' 'to' user_name / user_option+) / ('index' / 'function' / 'server' / 'procedure' / 'connector') qname rest)
%alter_action <- 'rename' ('to' (qname / partition) / 'column' qname 'to' ident / partition 'to' partition) / 'add' alter_add / 'drop' alter_drop / 'change' 'column'? qname ident type column_option* position? scope? / 'alter' 'column'? qname alter_column+ / 'replace' 'columns' '(' column_def (',' column_def)* ')' scope? / 'set' alter_set / 'unset' property_word if_exists? properties
  / 'recover' 'partitions' / 'exchange' partition 'with' 'table' qname / ('touch' / 'archive' / 'unarchive') partition? / 'compact' STRING rest? / 'concatenate' / ('enable' / 'disable') ('no_drop' 'cascade'? / 'offline') / table_clause / 'not' ('clustered' / 'sorted' / 'skewed' / 'stored' 'as' 'directories') / 'into' NUMBER 'buckets' / 'update' ('columns' / 'statistics' rest) / 'owner' 'to' user_name / 'execute' rest / 'partition' 'column' '(' field ')'
%alter_add <- if_not? added_partition (','? added_partition)* / 'range' partition_filter / constraint / ('columns' / 'column')? if_not? ('(' alter_columns ')' / column_def position?) scope?
%alter_columns <- column_def position? (',' column_def position?)*
%added_partition <- partition ('location' path / 'cached' 'in' STRING / 'uncached')*
%alter_drop <- if_exists? partition_filter (','? partition_filter)* ('purge' / 'ignore' 'protection')* / 'range' partition_filter / 'constraint' if_exists? ident / 'primary' 'key' / ('columns' / 'column') if_exists? ('(' qname (',' qname)* ')' / qname (',' qname)*) / !('columns' / 'column' / 'constraint' / 'range') qname
%alter_column <- 'type' type / 'set' ('data' 'type' type / 'default' sum / 'not' 'null' / ident value) / 'drop' ('not' 'null' / 'default') / 'comment' STRING / position
%alter_set <- property_word properties / 'location' path / 'serde' STRING ('with' 'serdeproperties' properties)? / 'fileformat' (ident / 'inputformat' STRING 'outputformat' STRING ('serde' STRING)?) / 'owner' ('user' / 'role' / 'group')? user_name / 'cached' 'in' STRING ('with' rest)? / 'uncached' / 'column' 'stats' ident properties / 'row' rest / 'skewed' 'location' properties / 'authorization' rest / 'tags' properties / ident '=' value
%property_word <- 'tblproperties' / 'dbproperties' / 'serdeproperties' / 'properties' / 'tags'
%partition_filter <- 'partition' '(' exprs ')'
%position <- 'first' / 'after' ident
%scope <- 'cascade' / 'restrict'
balanced <- ('(' balanced ')' / '[' balanced ']' / '{' balanced '}' / !';' !')' !']' !'}' !'(' !'[' !'{' !EOF any)*
rest <- (!marker (KEY / !';' !')' !']' !'}' !'(' !'[' !'{' !'*' OP))* operand ((!marker (KEY / !';' !')' !']' !'}' !'(' !'[' !'{' !'*' OP))* operand)*
%operand <- '(' rest? ')' / '[' rest? ']' / '{' rest? '}' / NAME / QUOTED_NAME / VARIABLE / STRING / NUMBER / '*' / 'null' / 'true' / 'false' / 'all'
%marker <- '<' '<' '<' / '==' '==' / '>' '>' '>'
words <- (!marker !';' !EOF any)+
%any <- NAME / KEY / STRING / NUMBER / OP / QUOTED_NAME / VARIABLE
""")
_TOKEN = re.compile(
    r"""(?xs)
      (?P<space>\s+ | --[^\n]* | /\*.*?\*/)
    | (?P<VARIABLE>\$\{[^}\n]*\} | \{\{[^}\n]*\}\} | \#\w+\# | \$[A-Za-z_]\w* | @\w+)
    | (?P<STRING>[rR]?'(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.|"")*")
    | (?P<QUOTED_NAME>`[^`]*`)
    | (?P<NUMBER>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYDF])?(?!\w))
    | (?P<NAME>[^\W\d]\w*(?:\$\{[^}\n]*\}\w*)* | \d+[A-Za-z_]\w*)
    | (?P<OP><=>|<>|!=|<=|>=|==|\|\||::|->|=>|&&|[-+*/%=<>(),.;\[\]{}:!?~^&|])
    """
)
_SETTING = re.compile(r"(?i)set\s+[\w.:\-]+\s*=\s*[^;\n]*")


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 1 if text.startswith("﻿") else 0
    while at < len(text):
        if text[at] in "sS" and (not out or out[-1].text == ";") and (m := _SETTING.match(text, at)):
            out.append(Token("SETTING", "\0", at))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        if not m:
            opened = text[at] in "'\"`" or text.startswith("/*", at)
            raise LexError(at, "unterminated string, name or comment" if opened else "bad character", opened)
        kind, t = m.lastgroup, m[0]
        if text.startswith("/*", at) and kind != "space":
            raise LexError(at, "unterminated comment", True)
        if kind == "NAME":
            t = t.lower()
            out.append(Token("KEY" if t in RESERVED else "NAME", t, at))
        elif kind != "space":
            out.append(Token(kind, t if kind == "OP" else "\0", at))
        at = m.end()
    return [*out, Token("EOF", "", len(text))]
