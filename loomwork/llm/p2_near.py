"""Near-duplicate records with small edits: tensored banding, then exact verification.

Texts become sets of neighbouring word pairs. Records with the same set are one
class and go on through their smallest id. Two small collections of ``side``
half keys of ``width`` minhashes each are computed; every pair of a half key
from the first and one from the second is a table key. So ``side ** 2`` tables
of ``2 * width`` hashes cost ``2 * side * width`` minhashes. Records that share
a table key are compared exactly.

Records share a table key where they share a half key of each collection. So
only first half keys are shuffled, and those of one record alone end there;
second ones are compared where first ones meet. Table keys are written out only
below first half keys of very many records. Sets are never stored: texts are
smaller, and only candidates are cut into words again.

With the defaults, a pair of similarity s meets with probability
``(1 - (1 - s**3) ** 16) ** 2``: 0.998 at 0.7, 0.9996 at 0.75, 0.99998 at 0.8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.skew import join_per_key
from ..session import drop, stage

#: Minhashes in a half key, and half keys in each of the two collections.
WIDTH, SIDE = 3, 16
#: Words that a text needs to take part.
LEAST_WORDS = 15
#: Rows of a table key or class that one task compares with each other; larger ones are spread over squares of tasks.
BUCKET = 5000
#: Rows of a first half key up to which its pairs are shuffled as ids, without their sketches.
FEW = 16
#: Second half keys go by LANE bits, LANES to a long and a free bit above each; what they let through is verified like all else.
LANE, LANES = 14, 4
#: Longs in the parity map of a set.
MAP = 4
#: Texts and bytes worked on at once, and bits of a hashed word pair; the text's number takes the bits above.
ROWS, BYTES, HASH = 256, 1 << 18, 56

_MIX = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789_"))
_P1, _P2, _P3, _P4, _P5 = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def word_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id, t: the lower-cased texts whose sets of word pairs are compared. Null texts take no part."""
    return df.select(F.col(row_id).cast("long").alias("id"), F.lower(F.col(text)).alias("t")).filter("t is not null")


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rotl(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _xxhash64(eights: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of the words that begin ``at`` and have ``size`` bytes. eights: the eight bytes from each place on."""
    h, left = seed + _P5, size % 32
    if len(big := np.flatnonzero(size >= 32)):
        lanes, stripes = [seed[big] + _P1 + _P2, seed[big] + _P2, seed[big].copy(), seed[big] - _P1], size[big] // 32
        for i in range(stripes.max()):
            on = np.flatnonzero(stripes > i)
            for j, lane in enumerate(lanes):
                lane[on] = _rotl(lane[on] + eights[at[big][on] + 32 * i + 8 * j] * _P2, 31) * _P1
        mixed = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ (_rotl(lane * _P2, 31) * _P1)) * _P1 + _P4
        h[big] = mixed
    h += size.astype(np.uint64)
    at, end = at + size - left, at + size
    for i in range(3):
        on = np.flatnonzero(left >= 8 * i + 8)
        h[on] = _rotl(h[on] ^ (_rotl(eights[at[on] + 8 * i] * _P2, 31) * _P1), 27) * _P1 + _P4
    on = np.flatnonzero(size % 8 >= 4)
    h[on] = _rotl(h[on] ^ ((eights[(end - size % 8)[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    for i in range(3):
        on = np.flatnonzero(size % 4 > i)
        h[on] = _rotl(h[on] ^ ((eights[(end - size % 4)[on] + i] & np.uint64(0xFF)) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _starts(marks: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]][: len(marks)])


def _pieces(*texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, rows) of stretches of at most ``ROWS`` rows, and ``BYTES`` bytes where no single row has more."""
    ends = np.cumsum(sum(pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    at = 0
    while at < len(ends):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        rows = min(max(to - at, 1), ROWS)
        yield at, rows
        at += rows


def _pairs(texts: pa.Array, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text, and the hash, of each pair of neighbouring words, in their order.

    Words are the longest runs of a-z, 0-9 and _. Texts of fewer than ``least_words`` words have no pairs.
    """
    none = np.zeros(0, dtype=np.uint64)
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if off[0] == off[-1]:
        return none, none
    data, off = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]
    at = _IN_WORD[data]
    before, after = np.r_[False, at[:-1]], np.r_[at[1:], False]
    before[off[:-1][off[:-1] < len(data)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    begin, size = np.flatnonzero(at & ~before), np.flatnonzero(at & ~after) + 1
    size -= begin
    count = np.diff(np.searchsorted(begin, off))
    row = np.repeat(np.arange(len(count)), count)
    near = np.flatnonzero((row[1:] == row[:-1]) & (count[row[1:]] >= max(2, least_words)))
    if not len(near):
        return none, none
    eights = np.ascontiguousarray(np.ndarray(len(data), "<u8", np.r_[data, np.zeros(7, np.uint8)].tobytes(), strides=(1,)))
    one = _xxhash64(eights, begin[near], size[near], np.full(len(near), 42, dtype=np.uint64))
    return row[near].astype(np.uint64), _xxhash64(eights, begin[near + 1], size[near + 1], one)


def _set(row: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The distinct pairs of each text, sorted: the text's number, then ``HASH`` bits of the pair's hash."""
    keys = np.sort((row << np.uint64(HASH)) | (pairs >> np.uint64(64 - HASH)))
    return keys[_starts(keys)]


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])), flat)


def _sketch(width: int, side: int, least_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 2**63, 2 * side * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, 2 * side * width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _pieces(batch["t"]):
                row, hashes = _pairs(batch["t"].slice(at, rows), least_words)
                if not len(row):
                    continue
                starts = _starts(row)
                half = np.zeros((2 * side, len(starts)), dtype=np.uint64)
                for j in range(2 * side):
                    for a, b in zip(mult[j * width : (j + 1) * width], add[j * width : (j + 1) * width], strict=True):
                        half[j] = _fold(half[j] * _MIX + np.minimum.reduceat(_fold(hashes * a + b), starts) + np.uint64(j + 1))
                keys = _set(row, hashes)
                row, pairs = keys >> np.uint64(HASH), keys & np.uint64((1 << HASH) - 1)
                starts = _starts(row)
                n = np.diff(np.r_[starts, len(keys)])
                same = np.stack([np.add.reduceat(_fold(pairs + add[0]), starts), np.add.reduceat(_fold(pairs * _MIX + add[1]), starts)], 1)
                second = np.zeros((len(starts), -(-side // LANES)), dtype=np.uint64)
                for j in range(side):
                    second[:, j // LANES] |= (half[side + j] & np.uint64((1 << LANE) - 1)) << np.uint64((LANE + 1) * (j % LANES))
                bits = np.bincount(np.repeat(np.arange(len(starts)), n) * (64 * MAP) + (pairs % np.uint64(64 * MAP)).astype(np.int64), minlength=len(starts) * 64 * MAP) & 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(at, rows).take(pa.array(row[starts])),
                        pa.array([k.tobytes() for k in same], pa.binary()),
                        pa.array(n.astype(np.int64)),
                        _lists(half[:side].T.astype(np.uint32).view(np.int32)),
                        _lists(second.view(np.int64)),
                        _lists(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, MAP)),
                    ],
                    names=["id", "k", "n", "u", "v", "m"],
                )

    return run


def sketches(texts: DataFrame, width: int = WIDTH, side: int = SIDE, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per text of enough words: id, k (of equal sets only), n (pairs), u, v (half keys of both collections), m.

    v holds ``LANES`` shortened half keys to a long. Bit i of the parity map m tells whether an odd number of pairs have
    the hash i: as many bits as two maps differ in, as many pairs at least are in one of the sets only.
    """
    return texts.mapInArrow(_sketch(width, side, least_words), "id long, k binary, n long, u array<int>, v array<long>, m array<long>")


def _verify(percent: int, least_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _pieces(batch["t_a"], batch["t_b"]):
                a, b = (_set(*_pairs(batch[t].slice(at, rows), least_words)) for t in ("t_a", "t_b"))
                both = np.sort(np.r_[a, b])
                count = lambda keys: np.bincount((keys >> np.uint64(HASH)).astype(np.int64), minlength=rows)  # noqa: B023, E731
                common = count(both[1:][both[1:] == both[:-1]])
                either = count(both) - common
                alike = pa.array(np.flatnonzero(100 * common >= percent * either))
                kept = batch.slice(at, rows).take(alike)
                yield pa.RecordBatch.from_arrays(
                    [kept["a"], kept["b"], pa.array(common).take(alike), pa.array(either).take(alike), kept["parts_a"], kept["parts_b"]],
                    names=["a", "b", "common", "either", "parts_a", "parts_b"],
                )

    return run


def classes(keyed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """id, rep, parts, part: records (id, k) with the same set of pairs, under the smallest id.

    A class of more than ``bucket`` records has several parts, and each record is in one.
    """
    keyed = keyed.select("id", "k")
    reps = stage(keyed.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes", tidy=True)
    parts = F.ceil(F.col("copies") / bucket).cast("int")
    return (
        join_per_key(keyed, reps, "k", "copies")
        .withColumn("parts", parts)
        .select("id", "rep", "parts", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    )


def _both(rows: DataFrame, keys: list[str], shown: list[str]) -> DataFrame:
    """Pairs a < b of the rows with the same keys; ``shown`` of both, with _a and _b."""
    x, y = (rows.select(*keys, F.col("id").alias(i), *(F.col(c).alias(f"{c}_{i}") for c in shown)) for i in ("a", "b"))
    return x.join(y.hint("merge"), keys).filter("a < b")


def _met(rows: DataFrame, shown: list[str], bucket: int) -> DataFrame:
    """Pairs a < b of the rows (key, id, k rows of the key) with the same key; ``shown`` of both, with _a and _b.

    A key with k rows is a square of (k / bucket) ** 2 cells, so a task has at
    most about bucket ** 2 pairs of one cell, whatever k is.
    """
    grid = rows.filter("k > 1").withColumn("g", F.ceil(F.col("k") / bucket).cast("int"))
    own, all_ = F.pmod(F.xxhash64("id"), "g").cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    x = grid.select("key", own.alias("r"), all_.alias("c"), F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in shown))
    y = grid.select("key", own.alias("c"), all_.alias("r"), F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in shown))
    return x.join(y.hint("merge"), ["key", "r", "c"]).filter("a < b")


def _may_be_alike(percent: int) -> str:
    """What holds for all pairs at least ``percent`` alike: of sizes n and parity maps m."""
    apart = " + ".join(f"bit_count(m_a[{i}] ^ m_b[{i}])" for i in range(MAP))
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * ({apart}) <= {100 - percent} * (n_a + n_b)"


def _share_second(side: int) -> str:
    """Whether v_a and v_b have a half key in common: adding all ones to an equal lane's zeros leaves the bit above free."""
    tests = []
    for i in range(-(-side // LANES)):
        lanes = [(LANE + 1) * j for j in range(min(LANES, side - i * LANES))]
        ones, above = sum(((1 << LANE) - 1) << j for j in lanes), sum(1 << (j + LANE) for j in lanes)
        tests.append(f"(((v_a[{i}] ^ v_b[{i}]) + {ones}L) & {above}L) <> {above}L")
    return "(" + " or ".join(tests) + ")"


def candidates(reps: DataFrame, percent: int, side: int = SIDE, bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """a < b, parts_a, parts_b: records (sketches and parts) that share a table key, and whose sizes and maps allow ``percent``.

    First half keys of one record are left out. Those of up to ``few`` give pairs of ids, which fetch their sketches once;
    those of up to ``bucket`` meet with their sketches. Below larger ones the table keys are written out, counted and met,
    where they are large again in squares. One step follows another, and table keys go by ``LANES`` of the second half keys,
    so that the shuffles of one alone are on disk.
    """
    few = min(few, bucket)
    each = reps.select("id", F.posexplode("u").alias("i", "u")).select("id", F.expr("shiftleft(cast(i as bigint), 32) | (cast(u as bigint) & 4294967295)").alias("key"))
    counted = lambda rows: rows.withColumn("k", F.count("*").over(Window.partitionBy("key"))).filter("k > 1")
    kept = stage(counted(each), "half_keys", tidy=True)
    shown = ["n", "v", "m", "parts"]
    allowed, pair = _may_be_alike(percent), ["a", "b", "parts_a", "parts_b"]
    of = lambda i: reps.select(F.col("id").alias(i), *(F.col(c).alias(f"{c}_{i}") for c in shown)).hint("merge")
    with_sketch = lambda rows: rows.join(reps.select("id", *shown).hint("merge"), "id")
    near = _both(kept.filter(F.col("k") <= few), ["key"], []).select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    found = [stage(near.filter(allowed).filter(_share_second(side)).select(pair), "near", tidy=True)]
    more = _both(with_sketch(kept.filter((F.col("k") > few) & (F.col("k") <= bucket))), ["key"], shown)
    found.append(stage(more.filter(allowed).filter(_share_second(side)).select(pair).distinct(), "more", tidy=True))
    large = kept.filter(F.col("k") > bucket)
    if not large.isEmpty():
        large, shown = stage(with_sketch(large.drop("k")), "large", tidy=True), ["n", "m", "parts"]
        for i in range(-(-side // LANES)):
            lanes = ", ".join(f"shiftright(v[{i}], {(LANE + 1) * j}) & {(1 << LANE) - 1}L" for j in range(min(LANES, side - i * LANES)))
            tables = large.select("id", *shown, "key", F.posexplode(F.expr(f"array({lanes})")).alias("j", "v"))
            tables = stage(counted(tables.select(F.xxhash64("key", "j", "v").alias("key"), "id", *shown)), "tables", tidy=True)
            met = (_both(tables.filter(F.col("k") <= bucket), ["key"], shown), _met(tables.filter(F.col("k") > bucket), shown, bucket))
            found.append(stage(reduce(DataFrame.union, (m.filter(allowed).select(pair) for m in met)).distinct(), "met", tidy=True))
            drop(tables)
        drop(large)
    drop(kept)
    return reduce(DataFrame.union, found).distinct()


def similar_classes(
    texts: DataFrame, percent: int = 70, width: int = WIDTH, side: int = SIDE, bucket: int = BUCKET, least_words: int = LEAST_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each text (id, t), and pairs of classes at least ``percent`` alike.

    members: id, rep, parts, part. links: a < b (representatives), common,
    either, and parts of both. No bucket is capped, and no join after an
    explode is left to an estimate of its size.
    """
    drawn = stage(sketches(texts, width, side, least_words), "sketches", tidy=True)
    members = stage(classes(drawn, bucket), "members", tidy=True)
    first = members.filter("id = rep").select("id", "parts")
    reps = stage(drawn.drop("k").join(first.hint("merge"), "id"), "representatives", tidy=True)
    drop(drawn)
    cand = stage(candidates(reps, percent, side, bucket), "candidates", tidy=True)
    drop(reps)
    side_of = lambda i: texts.select(F.col("id").alias(i), F.col("t").alias(f"t_{i}")).hint("merge")
    links = cand.join(side_of("a"), "a").join(side_of("b"), "b").mapInArrow(_verify(percent, least_words), "a long, b long, common long, either long, parts_a int, parts_b int")
    return members, links


def similar_pairs(df: DataFrame, row_id: str, text: str, percent: int = 70, bucket: int = BUCKET) -> DataFrame:
    """All pairs of rows at least ``percent`` alike, copies included: id_a < id_b, similarity.

    Links reach the records of large classes part by part, and copies meet in squares.
    """
    members, links = similar_classes(word_pairs(df, row_id, text), percent, bucket=bucket)
    links = stage(links, "links", tidy=True)
    of = lambda i, r: members.select(F.col("id").alias(i), F.col("rep").alias(r), F.col("part").alias(f"part_{r}")).hint("merge")
    parts = lambda r: F.explode(F.sequence(F.lit(0), F.col(f"parts_{r}") - 1)).alias(f"part_{r}")
    far = (
        links.select("*", parts("a"))
        .join(of("x", "a"), ["a", "part_a"])
        .select("*", parts("b"))
        .join(of("y", "b"), ["b", "part_b"])
        .select("x", "y", (F.col("common") / F.col("either")).alias("similarity"))
    )
    rows = members.select(F.col("rep").alias("key"), "id")
    sizes = stage(rows.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "sizes", tidy=True)
    same = _met(rows.join(sizes.hint("merge"), "key"), [], bucket)
    both = far.union(same.select("a", "b", F.lit(1.0)))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def groups(df: DataFrame, row_id: str, text: str, percent: int = 70) -> DataFrame:
    """One row per record that has copies or is like others: id, rep, group_id, links, copies.

    rep: smallest id with the same word pairs; group_id: smallest id among all
    records linked directly or through others; links: other classes at least
    ``percent`` alike; copies: rows of the class. Pairs of copies are not expanded.
    """
    members, links = similar_classes(word_pairs(df, row_id, text), percent)
    links = stage(links.select("a", "b"), "links", tidy=True)
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    comp = components(links, "a", "b").withColumnRenamed("node", "rep")
    size = stage(members.groupBy("rep").agg(F.count("*").alias("copies")), "sizes")
    of = (
        size.join(degree.hint("merge"), "rep", "left")
        .join(comp.hint("merge"), "rep", "left")
        .filter("copies > 1 or links is not null")
        .select("rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "copies")
    )
    return join_per_key(members, stage(of, "groups"), "rep", "copies").select("id", "rep", "group_id", "links", "copies")
