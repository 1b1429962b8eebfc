"""Text cut off by field limits: word trigrams inside texts against trigrams at ends, in SQL.

Texts become words, with a mark where a sentence, paragraph or block ends.
Every trigram of words is counted by what follows: more of the sentence, such a
mark, or the end of the text. The final trigram of a text tells a cut if it
goes on almost always elsewhere, or if its last word is the beginning of longer
words that follow the same two words. Where the trigram is too rare, the bigram
decides, then the word. Words within fenced code are words of their own: from
an opened fence a text always goes on, to the closing one, so such words are
counted as going on, and in code the last resort is all words of code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_per_key
from ..session import stage

#: Share of endings from which on words count as ones that end; occurrences that are evidence enough;
#: share of whole uses from which on a beginning of longer words counts as a word.
ENDS, EVIDENCE, WHOLE = 0.02, 3, 0.1

#: Signs that stand for a fence, and before words in code; taken out of texts.
FENCE, CODE = "\ue000", "\ue001"

#: Declarations, comments and tags (a name, then nothing, one word or attributes with values).
_TAG = r"<(?:[!?][^<>]*|/?[a-z][\w:.-]*(?=[^<>]*>)(?:\s[^<>=]*=[^<>]*|(?:\s+[\w:.-]+)?\s*/?))>"

_PARTS = r"r'https?://[^\s<>()\"`\x27]*|[¶§]|\p{IsHan}|[a-z0-9_[\p{L}\p{N}&&[^\p{IsHan}]]]+'"

#: Text to words, every number 0; ¶ marks the end of a sentence or paragraph, § that of a block (fence, closing tag).
_WORDS = rf"""
SELECT id, source, CASE WHEN NOT fenced THEN regexp_extract_all(body, {_PARTS}, 0) ELSE flatten(transform(split(body, '{FENCE}'), (s, i) -> CASE
    WHEN i % 2 = 1 THEN concat(array('§', '{CODE}```'), transform(filter(regexp_extract_all(s, {_PARTS}, 0), x -> x NOT IN ('¶', '§')), x -> concat('{CODE}', x)))
    WHEN i > 0 THEN concat(array('§'), regexp_extract_all(s, {_PARTS}, 0))
    ELSE regexp_extract_all(s, {_PARTS}, 0) END)) END AS w
FROM (
  SELECT id, source, contains(low, '```') AS fenced, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '[0-9]+(?:[.,:][0-9]+)*', '0'),
      r'```[a-z]*', '{FENCE}'),
      r'</(?:p|pre|code|li|ul|ol|div|h[1-6]|blockquote)>', ' § '),
      r'{_TAG}', ' '),
      r'(?:[.?!…:])+(?=[\s"*)_`\x27¶§{FENCE}]|$)|[。！？…]+|[.?!]+(?=\p{{IsHan}})|\n\s*\n', ' ¶ ') AS body
  FROM (SELECT id, source, lower(CASE WHEN right(text, 3) RLIKE r'(?:\s|…|[.]{{3}}|[.…]\])$' THEN regexp_replace(text, r'(?:\[(?:[.]{{3}}|…)\]|[.]{{3}}|…|\s)+$', '') ELSE text END) AS low
        FROM (SELECT id, source, CASE WHEN text RLIKE '[¶§{FENCE}{CODE}]' THEN translate(text, '¶§{FENCE}{CODE}', '    ') ELSE text END AS text
        FROM {{docs}} WHERE text RLIKE r'\S')))"""

#: The place of the final word, and whether a block ends after it.
_PLACED = """
SELECT id, source, w, z, array_contains(slice(w, z + 2, size(w)), '§') AS closed FROM (
  SELECT *, CAST(coalesce(size(w) - nullif(array_position(transform(reverse(w), x -> x IN ('¶', '§')), false), 0), -1) AS INT) AS z FROM {words})"""

#: Words with their classes (links become shapes, names with underscores x_x).
_CLASSED = rf"""
SELECT id, source, w, z, closed, transform(w, x -> CASE
    WHEN contains(x, '_') AND NOT contains(x, '/') THEN CASE WHEN startswith(x, '{CODE}') THEN '{CODE}x_x' ELSE 'x_x' END
    WHEN NOT contains(x, '/') THEN x
    ELSE concat(regexp_extract(x, '^{CODE}?https?://', 0), regexp_replace(substr(x, length(regexp_extract(x, '^{CODE}?https?://', 0)) + 1), '[a-z]+', 'u')) END) AS k
FROM {{placed}}"""

#: What is said of a word at place pos: its two words before (after a mark, the mark alone), its class and itself.
_SHOWN = """CASE WHEN b IN ('¶', '§') THEN '¶' ELSE replace(a, '§', '¶') END AS a, replace(b, '§', '¶') AS b, c,
  CASE WHEN contains(c, 'http') AND contains(c, '://') THEN c ELSE x END AS raw"""
_STOPS = f"coalesce(next IN ('¶', '§'), false) AND NOT startswith(c, '{CODE}')"

#: One row per word: its trigram, and what follows (stop: a mark; last: the text's end; own: it is the text's final word).
#: The final word of code that is closed goes on to the closing fence.
_TRIGRAMS = f"""
SELECT {_SHOWN}, {_STOPS} AS stop, pos = z AS own, pos = z AND NOT (closed AND startswith(c, '{CODE}')) AS last FROM (
  SELECT z, closed, t.* FROM {{classed}}
  LATERAL VIEW inline(arrays_zip(concat(array('^', '^'), k), concat(array('^'), k), k, w, slice(k, 2, size(k)), sequence(0, size(k) - 1))) t AS a, b, c, x, next, pos)
WHERE c IS NOT NULL AND c NOT IN ('¶', '§')"""

#: The final trigram of each text.
_FINALS = f"""
SELECT id, source, closed, stop, struct(a, b, c, raw) AS t FROM (
  SELECT id, source, closed, {_SHOWN}, {_STOPS} AS stop FROM (
    SELECT id, source, closed, coalesce(get(k, z - 2), '^') AS a, coalesce(get(k, z - 1), '^') AS b, k[z] AS c, w[z] AS x, get(k, z + 1) AS next
    FROM {{classed}} WHERE z >= 0))"""

#: Per trigram and spelling: occurrences that go on, that end within a text, that end a text, and that are final words.
_COUNTS = """
SELECT a, b, c, raw, count_if(NOT last AND NOT stop) AS goes_on, count_if(NOT last AND stop) AS ends, count_if(last) AS finals, count_if(own) AS own
FROM {trigrams} GROUP BY a, b, c, raw"""

#: The same for a shorter {key}.
_SHORTER = """
SELECT {key}c, raw, sum(goes_on) AS goes_on, sum(ends) AS ends, sum(finals) AS finals, sum(own) AS own FROM {counts} GROUP BY {key}c, raw"""

#: Evidence for the distinct final words after the same {key}: what the same class of word does elsewhere (finals:
#: other texts), and the uses of longer words of which the final word is the beginning (beginnings as long as some final word).
_LEVEL = """
WITH f AS (SELECT {key}c, raw, own FROM {counts} WHERE own > 0),
same AS (SELECT {key}c, sum(goes_on) AS goes_on, sum(ends) AS ends, sum(finals) AS finals FROM {counts} GROUP BY {key}c),
pieces AS (SELECT {key}raw, sum(goes_on + ends) AS uses FROM {counts} GROUP BY {key}raw),
longer AS (SELECT {key}substr(raw, 1, n) AS raw, sum(uses) AS longer
  FROM (SELECT *, (SELECT collect_set(length(raw)) FROM {words} WHERE own > 0) AS lengths FROM pieces WHERE length(raw) > 1 AND uses > 0)
  LATERAL VIEW explode(filter(lengths, n -> n < length(raw))) AS n GROUP BY {key}substr(raw, 1, n))
SELECT /*+ MERGE(f, same, longer, pieces) */ f.*, same.goes_on, same.ends, same.finals - 1 AS finals, coalesce(longer.longer, 0) AS longer, coalesce(pieces.uses, 0) AS uses
FROM f JOIN same USING ({key}c) LEFT JOIN longer USING ({key}raw) LEFT JOIN pieces USING ({key}raw)"""


def _ends_rarely(k: str, evidence: int = EVIDENCE) -> str:
    total = f"({k}.goes_on + {k}.ends + {k}.finals + CASE WHEN {k}.goes_on + {k}.ends = 0 THEN {k}.longer ELSE 0 END)"
    return f"WHEN {total} >= {evidence} THEN {k}.ends + greatest(0, {k}.finals - 1) < {ENDS} * {total}"


_PIECE = f"WHEN l1.uses = 0 AND l1.longer >= {EVIDENCE} AND l1.own <= {WHOLE} * l1.longer THEN true"
_BY_COUNTS = f"{_ends_rarely('l3')} {_ends_rarely('l2')} {_ends_rarely('l1')} WHEN startswith(c, '{CODE}') THEN CASE {_ends_rarely('code', 1)} END"

#: Per distinct final trigram, with its number of texts n: whether it tells a cut (mid), also where a full stop follows (after_stop).
_DECIDED = f"""
SELECT struct(a, b, c, raw) AS t, n, l3.goes_on, l3.ends, l3.finals, l3.longer,
  coalesce(CASE {_PIECE} {_BY_COUNTS} END, false) AS mid,
  coalesce(CASE {_PIECE} WHEN NOT CASE {_ends_rarely("l1")} ELSE false END THEN false {_BY_COUNTS} END, false) AS after_stop -- does the word end sentences
FROM (
  SELECT /*+ MERGE(x, y, z) */ f.a, f.b, f.c, f.raw, f.own AS n, struct(x.*) AS l3, struct(y.*) AS l2, struct(z.*) AS l1,
    (SELECT struct(sum(goes_on) AS goes_on, sum(ends) AS ends, sum(finals) - 1 AS finals, 0 AS longer) FROM {{words}} WHERE startswith(c, '{CODE}')) AS code
  FROM (SELECT * FROM {{counts}} WHERE own > 0) f
  LEFT JOIN {{l3}} x ON f.a = x.a AND f.b = x.b AND f.c = x.c AND f.raw = x.raw
  LEFT JOIN {{l2}} y ON f.b = y.b AND f.c = y.c AND f.raw = y.raw
  LEFT JOIN {{l1}} z ON f.c = z.c AND f.raw = z.raw)"""


def _sql(spark, query: str, **views: DataFrame) -> DataFrame:
    for name, df in views.items():
        view = f"cut_{name}_{uuid.uuid4().hex[:10]}"
        df.createOrReplaceTempView(view)
        query = query.replace("{" + name + "}", view)
    return spark.sql(query)


def judged(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """One row per text with words: id, source, the evidence of its final trigram, cut.

    Null and blank texts, and texts without any word, are no cases. Words are
    compared at full length.
    """
    spark = docs.sparkSession
    named = docs.selectExpr(f"cast(`{doc_id}` AS bigint) AS id", f"`{text}` AS text", f"`{source}` AS source")
    placed = _sql(spark, _PLACED, words=_sql(spark, _WORDS, docs=named))
    classed = stage(_sql(spark, _CLASSED, placed=placed), "words")
    counts = stage(_sql(spark, _COUNTS, trigrams=_sql(spark, _TRIGRAMS, classed=classed)), "trigrams")
    pairs = stage(_sql(spark, _SHORTER.replace("{key}", "b, "), counts=counts), "pairs")
    single = stage(_sql(spark, _SHORTER.replace("{key}", ""), counts=pairs), "single")
    level = lambda key, c: _sql(spark, _LEVEL.replace("{key}", key), counts=c, words=single)
    levels = {"l3": level("a, b, ", counts), "l2": level("b, ", pairs), "l1": level("", single)}
    decided = stage(_sql(spark, _DECIDED, counts=counts, words=single, **levels), "decided")
    cut = ~F.col("closed") & F.when(F.col("stop"), F.col("after_stop")).otherwise(F.col("mid"))
    return join_per_key(_sql(spark, _FINALS, classed=classed), decided, "t", "n").select(
        "id", "source", "t.a", "t.b", "t.raw", "goes_on", "ends", "finals", "longer", cut.alias("cut")
    )


def rates(judged_docs: DataFrame) -> DataFrame:
    """Texts, cut texts and their rate per source (null sources are one)."""
    return _sql(
        judged_docs.sparkSession,
        "SELECT source, count(*) AS texts, count_if(cut) AS cut_texts, count_if(cut) / count(*) AS rate FROM {d} GROUP BY source",
        d=judged_docs,
    )
