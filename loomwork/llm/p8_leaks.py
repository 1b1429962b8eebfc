"""Evaluation texts leaking into training text: a distributed positional inverted index and offset intersection.

The corpus is indexed once, in the shared folder: a row per word with its
document and position, in shards of documents and sorted by term within them, so
that no term is one task's however frequent it is; and beside it the words of
each document. A test item is looked up through its rarest terms: windows of
four neighbouring words are chosen so that every stretch of half the item holds
one whole window. As only single words may be replaced, two words of the window
then stand in any matching document at the same offset. Only the postings of
the windows' terms are read. The candidates (document, item, offset) that have
two such words are verified on the words of the document. Items of up to six
words have windows of half their words; of one or two words, a single one must
stand there.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import bounded
from ..session import stage, work_path

#: Only items without words take no part.
LEAST_WORDS = 1
#: Words of a window at most.
WINDOW = 4
#: Rows of a block of query terms: each block is broadcast to the index, and a set of items may have any number of blocks.
BLOCK = 200_000
#: Declarations, comments and tags (a name, then nothing, one word or attributes with values), and entities.
MARKUP = r"<[!?][^<>]*>|</?[A-Za-z][\w:.-]*(?=[^<>]*>)(?:\s[^<>=]*=[^<>]*|(?:\s+[\w:.-]+)?\s*/?)>|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def words(text: str) -> F.Column:
    """Words in order: runs of letters and digits of the lower-cased text without markup."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.col(text), MARKUP, " ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


class PositionalIndex:
    """Postings of a corpus in the shared folder: term (a hash of the word), doc, pos; and the words of each document."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> PositionalIndex:
        """Index every word of every document; null texts have none.

        No shuffle: a shard is what one task reads, sorted by term. Documents
        keep their place, and a term its shards.
        """
        spark = docs.sparkSession
        index = cls(spark, path or work_path(spark, "postings"))
        docs.select(F.col(doc_id).cast("long").alias("doc"), words(text).alias("w")).filter("size(w) > 0").write.parquet(f"{index.path}/words")
        (
            index.words()
            .select("doc", F.posexplode("w").alias("pos", "term"))
            .select(F.xxhash64("term").alias("term"), "doc", "pos")
            .sortWithinPartitions("term")
            .write.parquet(f"{index.path}/postings")
        )
        return index

    def words(self) -> DataFrame:
        """doc, w: the words of each document that has some."""
        return self.spark.read.schema("doc long, w array<string>").parquet(f"{self.path}/words")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """All postings, or those of some terms with the columns of ``terms`` (term and others; staged), block by block."""
        got = self.spark.read.schema("term long, doc long, pos int").parquet(f"{self.path}/postings")
        if terms is None:
            return got
        blocks = max(1, math.ceil(terms.count() / BLOCK))
        own = F.pmod(F.hash(*terms.columns), F.lit(blocks))
        return reduce(DataFrame.union, (got.join(F.broadcast(terms.filter(own == b)), "term") for b in range(blocks)))


def item_words(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """item, n, q, word: each word of each passage of at least LEAST_WORDS words."""
    w = items.select(F.col(item_id).cast("long").alias("item"), words(passage).alias("w")).dropDuplicates(["item"])
    return w.filter(F.size("w") >= LEAST_WORDS).select("item", F.size("w").alias("n"), F.posexplode("w").alias("q", "word"))


def _anchors(g: pd.DataFrame) -> pd.DataFrame:
    """The cheapest windows of which every stretch of half the item holds one, and the words of them that a match has at least.

    Of four words two are there, as no two neighbours are replaced. A window of
    three is half an item: all windows are taken, and the one in which a match
    begins has its first word and one of the next two. In one or two words it is one.
    """
    g = g.sort_values("q")
    n, df = len(g), g["uses"].fillna(0).to_numpy()
    half = math.ceil(n / 2)
    size = min(WINDOW, half)
    last = n - size
    cost = [float(df[p : p + size].sum()) for p in range(last + 1)]
    best, back = [math.inf] * (last + 1), [-1] * (last + 1)
    for p in range(last + 1):
        if p <= half - size:
            best[p] = cost[p]
        for b in range(max(0, p - max(1, half - size + 1)), p):
            if best[b] + cost[p] < best[p]:
                best[p], back[p] = best[b] + cost[p], b
    p = min(range(max(0, n - half), last + 1), key=best.__getitem__)
    out = []
    while p >= 0:
        out.append(g[(g["q"] >= p) & (g["q"] < p + size)].assign(win=p, need=2 if size > 2 else 1))
        p = back[p]
    return pd.concat(out)[["item", "win", "need", "q", "term"]]


def matches(index: PositionalIndex, items: DataFrame, item_id: str, passage: str, gap: int = 2, share: float = 0.5) -> DataFrame:
    """doc, item, words, of: documents that hold at least ``share`` (half or more) of an item's words in one stretch.

    ``gap`` 2 lets single words be replaced (proximity), 1 asks for the exact
    phrase. ``words`` is the length of the longest stretch, ``of`` that of the
    item. Documents and items without words have no rows.
    """
    terms = stage(item_words(items, item_id, passage).withColumn("term", F.xxhash64("word")), "terms")
    uses = index.postings(stage(terms.select("term").distinct(), "asked")).groupBy("term").agg(F.count("*").alias("uses"))
    anchors = stage(
        terms.join(uses.hint("merge"), "term", "left").groupBy("item").applyInPandas(_anchors, "item long, win int, need int, q int, term long"),
        "anchors",
    )
    met = index.postings(anchors).groupBy("item", "doc", (F.col("pos") - F.col("q")).alias("off"), "win")
    met = met.agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need")
    cand = stage(met.groupBy("item", "doc").agg(F.collect_set("off").alias("offs")), "candidates")
    passages = stage(terms.groupBy("item").agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(q, word))), x -> x.word)").alias("p")), "passages")
    asked = index.words().join(bounded(stage(cand.select("doc").distinct(), "documents")), "doc", "left_semi")
    both = cand.join(asked.hint("merge"), "doc").join(bounded(passages), "item")
    longest = f"""aggregate(sequence(0, n - 1), named_struct('from', -1, 'last', -1000, 'best', 0),
        (s, q) -> CASE WHEN p[q] = get(w, off + q) THEN named_struct(
            'from', CASE WHEN q - s.last > {int(gap)} THEN q ELSE s.from END, 'last', q,
            'best', greatest(s.best, q - CASE WHEN q - s.last > {int(gap)} THEN q ELSE s.from END + 1)) ELSE s END, s -> s.best)"""
    found = both.select("doc", "item", F.expr(f"array_max(transform(offs, off -> {longest}))").alias("words"), F.col("n").alias("of"))
    return found.filter(F.col("words") >= F.col("of") * F.lit(share))
