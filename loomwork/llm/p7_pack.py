"""Filling fixed-capacity containers with whole documents: swap-based local search.

Documents are spread over groups of bounded size by a hash of their id. In a
group each container type is filled by best fit in falling order of size, then
improved: documents move, or change places one for one and two for one, between
the least filled containers and others whenever that increases the sum of the
squared fills, until containers become empty. The few containers of a group
that stay underfull are opened again, and their documents packed together with
those of other groups, in rounds.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Documents that one task packs at a time; groups are made so that this holds on average.
GROUP = 4000
#: Containers filled to this share are closed after a round.
CLOSED = 0.995
#: Containers with less free space than this share are not searched from.
SLACK = 0.02
#: Container types that a specification may have.
MOST_TYPES = 1000


# --- fixed value: how byte-level BPE vocabularies of 50k tokens cut texts into words ---
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a file's lines: a token in base64, a space, its rank."""
    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None) -> DataFrame:
    """doc, size: tokens of each non-blank text, by the vocabulary file (ranks of a byte-level BPE) at ``vocabulary``.

    The driver reads the file, about a megabyte, and sends it to the tasks; a
    file that is missing raises. Only for None there is one token per run of
    letters or digits and one per other visible character. Null and blank
    texts, and null ids, take no part.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("t")).filter(r"t rlike '\\S' and doc is not null")
    if vocabulary is None:
        return src.select("doc", F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).alias("size"))
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        enc = _encoding(ranks.value)
        return s.map(lambda x: len(enc.encode_ordinary(x)))

    return src.select("doc", count("t").alias("size"))


class _Bins:
    """Containers with their documents, and the free space of each in order."""

    def __init__(self, sizes: dict[int, int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, docs: list[int]) -> None:
        space: list[tuple[int, int]] = []  # (free, container) in order
        for d in sorted(docs, key=lambda d: (-self.sizes[d], d)):
            s = self.sizes[d]
            k = bisect.bisect_left(space, (s, -1))
            if k == len(space):
                self.items.append([d])
                self.free.append(self.capacity - s)
                b = len(self.items) - 1
            else:
                _, b = space.pop(k)
                self.items[b].append(d)
                self.free[b] -= s
            if self.free[b] > 0:
                bisect.insort(space, (self.free[b], b))

    def _gain(self, a: int, b: int, out: int, back: int) -> int:
        """Change of the sum of squared fills (halved) if ``out`` tokens go from a to b and ``back`` from b to a."""
        fa, fb, d = self.capacity - self.free[a], self.capacity - self.free[b], out - back
        return d * (fb - fa) + d * d

    def _change(self, a: int, b: int, out: list[int], back: list[int]) -> None:
        for d in out:
            self.items[a].remove(d)
            self.items[b].append(d)
        for d in back:
            self.items[b].remove(d)
            self.items[a].append(d)
        moved = sum(self.sizes[d] for d in out) - sum(self.sizes[d] for d in back)
        self.free[a] += moved
        self.free[b] -= moved

    def _improve(self, a: int, b: int) -> bool:
        """One move or exchange between a (less filled) and b that increases squared fill; False if there is none."""
        z, room = self.sizes, self.free[b]
        if room <= 0:
            return False
        mine, theirs = sorted(self.items[a], key=z.__getitem__), sorted(self.items[b], key=z.__getitem__)
        fits = [d for d in mine if z[d] <= room]
        if fits:
            self._change(a, b, [fits[-1]], [])
            return True
        best, what = 0, None
        keys = [z[d] for d in mine]
        for y in theirs:  # one for one: the largest of mine that fits in y's place
            k = bisect.bisect_right(keys, z[y] + room) - 1
            if k >= 0 and keys[k] > z[y] and (g := self._gain(a, b, keys[k], z[y])) > best:
                best, what = g, ([mine[k]], [y])
        for i, x in enumerate(mine):  # two of mine for one
            for y in theirs:
                k = bisect.bisect_right(keys, z[y] + room - z[x], 0, i) - 1
                if k >= 0 and z[x] + keys[k] > z[y] and (g := self._gain(a, b, z[x] + keys[k], z[y])) > best:
                    best, what = g, ([x, mine[k]], [y])
        if what is None:
            return False
        self._change(a, b, *what)
        return True

    def local_search(self) -> None:
        """Changes until none raises the sum of squared fills, which each does by one token at least."""
        others = sorted((b for b in range(len(self.items)) if self.free[b] > 0), key=lambda b: -self.free[b])
        order = [b for b in others if self.free[b] > SLACK * self.capacity]
        for a in order:
            again = True
            while again:  # a change may open another container that was looked at before
                again = False
                for b in others:
                    while self.items[a] and b != a and self.items[b] and self.free[a] >= self.free[b] and self._improve(a, b):
                        again = True
                    if not self.items[a]:
                        break


def _pack(sizes: dict[int, int], capacity: int) -> list[list[int]]:
    """Containers of documents none of which exceeds the capacity."""
    bins = _Bins(sizes, capacity)
    bins.best_fit(list(sizes))
    bins.local_search()
    return [b for b in bins.items if b]


def _packer(n: int, last: bool):
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        cap, kind, no = int(g["capacity"].iloc[0]), g["container_type"].iloc[0], int(g["grp"].iloc[0])
        keys = list(zip(g["doc"], g["piece"], strict=True))
        sizes = dict(enumerate(g["size"].tolist()))
        rows = []
        for i, b in enumerate(_pack(sizes, cap)):
            closed = last or sum(sizes[d] for d in b) >= CLOSED * cap
            rows += [(kind, cap, f"{n}-{no}-{i}", *keys[d], sizes[d], closed) for d in b]
        return pd.DataFrame(rows, columns=["container_type", "capacity", "container", "doc", "piece", "size", "closed"])

    return pack


def containers(sizes: DataFrame, spec: DataFrame, rounds: int = 2, group: int = GROUP) -> DataFrame:
    """container_type, capacity, container, doc, piece, size: where each document goes.

    ``sizes``: doc, size; ``spec``: container_type, capacity_tokens. Every
    document is in one container of each type, whole, unless it exceeds the
    capacity: then it is split into full containers of its own and a rest
    (piece > 0) that is packed like a document. Rows of a doc that repeats
    count once; documents of size 0 take no space; types without a positive
    capacity are left out.
    """
    types = spec.select("container_type", F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0").distinct().limit(MOST_TYPES + 1).collect()
    if len(types) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} container types")
    kinds = F.array(*(F.struct(F.lit(t["container_type"]).cast("string").alias("container_type"), F.lit(t["capacity"]).alias("capacity")) for t in types))
    if not types:
        kinds = F.array().cast("array<struct<container_type: string, capacity: int>>")
    docs = sizes.groupBy("doc").agg(F.max("size").alias("size"))
    pieces = (
        docs.select("doc", "size", F.inline(kinds))
        .withColumn("full", F.expr("CAST(CASE WHEN size > capacity THEN (size - 1) DIV capacity ELSE 0 END AS INT)"))
        .select("container_type", "capacity", "doc", F.explode(F.expr("sequence(0, full)")).alias("piece"), "size", "full")
        .withColumn("size", F.expr("CASE WHEN piece < full THEN capacity ELSE size - full * capacity END").cast("int"))
        .drop("full")
    )
    pieces = stage(pieces, "pieces")
    whole = pieces.filter("size = capacity")
    out = [whole.select("container_type", "capacity", F.concat_ws("-", F.lit("f"), "doc", "piece").alias("container"), "doc", "piece", "size")]
    left = pieces.filter("size < capacity")
    schema = "container_type string, capacity int, container string, doc long, piece int, size int, closed boolean"
    for n in range(rounds):
        totals = left.groupBy("container_type", "capacity").count().collect()  # MOST_TYPES rows at most
        if not totals:
            break
        last = n == rounds - 1
        of_type = F.lit(1)
        for t in totals:
            if (g := math.ceil(t["count"] / group)) > 1:
                of_type = F.when(F.col("container_type").eqNullSafe(F.lit(t["container_type"])) & (F.col("capacity") == t["capacity"]), g).otherwise(of_type)
        packed = stage(
            left.withColumn("grp", F.pmod(F.xxhash64("doc", "piece", F.lit(n)), of_type).cast("int"))
            .groupBy("container_type", "capacity", "grp")
            .applyInPandas(_packer(n, last), schema),
            "packed",
        )
        out.append(packed.filter("closed").drop("closed"))
        left = packed.filter("not closed").select("container_type", "capacity", "doc", "piece", "size")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def fills(packed: DataFrame) -> DataFrame:
    """Per type: containers, documents, tokens, and the share of the space that is used."""
    per = packed.groupBy("container_type", "capacity", "container").agg(F.sum("size").alias("used"), F.count("*").alias("docs"))
    return per.groupBy("container_type", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("docs").alias("documents"),
        F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count("*") * F.col("capacity"))).alias("filled"),
    )
