"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are lower-cased runs without white space; a k-mer is five words, labelled by how often it came before in the text.
Under each of ``TABLES`` hash functions the ``TUPLE`` smallest labelled k-mers are taken and hashed in text order, so two texts
meet in a table only if they share those k-mers in the same order. Texts of equal words are one class from the start.

Texts of at most ``SHORT`` windows also meet by prefixes, which miss no pair of them: of n windows at least 0.8 n are in common, so the
``SHARED`` smallest common ones are among the n - 0.8 n + ``SHARED`` smallest of both; each choice of ``SHARED`` of those is a key.

Pairs that meet, and whose 256 one-bit minima do not rule it out, are aligned word by word in a band around the diagonal that
grows until the edit distance fits. Their similarity is the number of five-word windows inside matched runs over all
windows of both texts; 0.8 or more is a link. A class is a connected set of links.

First each text is compared with one leader of its bucket in ``STARS`` tables, which joins most groups. Then only texts of different
classes meet: in a bucket of at most ``CROWD`` texts all of them. Larger buckets come of passages that many texts share, or of large groups
of copies; their texts meet anew by rare windows (``rare_keys``), which loses no link: of n windows 0.8 n at least are in common, so under
any order of all windows both texts have the first common one among their n - 0.8 n + 1 first. Rare windows come first, so a common passage is
no key unless a text is hardly anything else, and the places of a shared window bound what two texts can have in common. A window that no other
text holds is no key, whatever its rank. Of the smaller text 8 windows in 9 at least are in common, so only windows among the first n / 9 + 1 of
some text, and texts of a size that fits, make a group.
Of a group with at most ``SMALL`` texts outside its largest class these meet all members, which leaves no pair of two classes. In any other group a
few leaders, ``LEADERS`` times as many each round, meet all members of other classes, until few are outside or all members that never led
are in one class. So a group of thousands of like texts costs a few comparisons each, and no partner is capped.

Texts without words (null, empty) are a class of their own each. Texts under five words link only to equal ones.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.common import chunks, find_package, free_name, map_text
from rasterloom.llm.components import components
from rasterloom.session import materialize

K = 5
TABLES = 32
TUPLE = 5
SIMILARITY = 0.8
CROWD = 32
SMALL = 512
STARS = 8
PAIRS_PER_TASK = 500
#: Leaders of a large bucket in the first round, and how many times as many there are in each later one.
LEADERS = 16
#: Members of a large group that a task compares with its leaders, about.
SPREAD = 4096
#: Windows are ordered by how often their slot was counted; any order is right, this one keeps frequent windows last. Slots are counted in blocks.
SLOT_BITS, BLOCK_BITS = 22, 14
#: Texts of ``SHARED`` to ``SHORT`` windows meet by prefixes too.
SHORT, SHARED = 15, 4
BITS = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.random.default_rng(7).integers(0, 2**63, TABLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that close inputs differ in all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hash of each window of ``K`` word hashes with its occurrence label; a shorter text is one window."""
    n = max(1, len(words) - K + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(K, len(words))):
        h = mixed(h * _MIX + words[i : i + n])
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        label = np.empty(n, np.uint64)
        label[order] = (at - first).astype(np.uint64)
        h = mixed(h + label * _MIX)
    return h


def order_sketch(h: np.ndarray) -> np.ndarray:
    """One key per table: the ``TUPLE`` smallest k-mers of the table's order, hashed as they stand in the text."""
    n, take = len(h), min(TUPLE, len(h))
    keys = np.empty(TABLES, np.uint64)
    step = max(1, 4_000_000 // n)
    for a in range(0, TABLES, step):
        odd = _ODD[a : a + step, None]
        ranked = h[None, :] * odd
        ranked ^= ranked >> np.uint64(32)
        ranked *= _MIX
        at = np.sort(np.argpartition(ranked, take - 1, axis=1)[:, :take], axis=1)
        key = np.zeros(len(odd), np.uint64)
        for i in range(take):
            key = mixed(key * _MIX + h[at[:, i]])
        keys[a : a + step] = key
    return keys


def short_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a short text: any two such texts with a share of ``SIMILARITY`` of their windows in common have one in common."""
    n = len(h)
    if not SHARED <= n <= SHORT:
        return np.empty(0, np.uint64)
    first = np.sort(h)[: n - math.ceil(SIMILARITY * n) + SHARED]
    chosen = np.array(list(combinations(first, SHARED)), np.uint64)
    key = np.zeros(len(chosen), np.uint64)
    for i in range(SHARED):
        key = mixed(key * _MIX + chosen[:, i])
    return key


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """256 bits: the smallest value of each of 256 hash ranges gives its last bit."""
    s = np.sort(h)
    top = (s >> np.uint64(56)).astype(np.int64)
    first = np.concatenate([[True], top[1:] != top[:-1]])
    bits = np.zeros(BITS, np.uint8)
    bits[top[first]] = (s[first] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


#: Dropped ids that may be broadcast: 16 bytes each.
BROADCAST_ROWS = 1_000_000
#: Texts of at most so many windows carry a hash of each, so that what they share is counted before a text is moved.
WINDOWS = 64
_SKETCH = "id bigint, digest string, n int, keys array<bigint>, w array<int>, b0 bigint, b1 bigint, b2 bigint, b3 bigint"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def windows(plain: list[str]) -> list[np.ndarray | None]:
    """The labelled windows of each normal text, None under ``K`` words."""
    split = pc.split_pattern(pa.array(plain, pa.string()), " ")
    flat = split.flatten().dictionary_encode()
    named = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    words = named[flat.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return [kmers(w) if len(w) >= K else None for w in np.split(words, ends[:-1])]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each slot's windows come in the texts of a task, 255 at most: a row per block of slots."""
    counts = np.zeros(1 << SLOT_BITS, np.int32)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts, 2_000_000):
            for h in windows([normal(t) for t in texts[a:b]]):
                if h is not None:
                    np.add.at(counts, _slot(h), 1)
    used = np.flatnonzero(counts)
    block = used >> BLOCK_BITS
    at, c = (used & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), np.minimum(counts[used], 255).astype(np.uint8)
    firsts = np.flatnonzero(np.diff(block, prepend=-1))
    spans = list(zip(firsts, [*firsts[1:], len(used)]))
    held = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (at, c)]
    yield pa.RecordBatch.from_arrays([pa.array(block[firsts].astype(np.int32)), *held], names=["block", "at", "c"])


def _block_codes(key, rows):
    """The codes of a block's slots: 0 and 1 for a sum of 0 and 1, larger ones for larger sums."""
    import pandas as pd

    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for at, c in zip(rows["at"], rows["c"]):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(c, np.uint8)
    code = np.where(total < 2, total, np.minimum(255, 2 + np.floor(8 * np.log2(np.maximum(total, 2) / 2)))).astype(np.uint8)
    return pd.DataFrame({"block": [key[0]], "codes": [code.tobytes()]})


def slot_codes(crowd: DataFrame) -> np.ndarray:
    """A byte per slot that orders slots by their count; at most 1 where a single text holds its windows. Its size is the same for any input."""
    codes = np.zeros((1 << SLOT_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    counted = crowd.select("text").mapInArrow(_slots, "block int, at binary, c binary")
    for r in counted.groupBy("block").applyInPandas(_block_codes, "block int, codes binary").collect():
        codes[r["block"]] = np.frombuffer(r["codes"], np.uint8)
    return codes.ravel()


def rare_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest windows of a text, as many as must hold one in common with any text of ``SIMILARITY``, rarest first."""
    first = np.lexsort((h, counts[_slot(h)]))
    return h[first[: len(h) - math.ceil(SIMILARITY * len(h)) + 1]]


def _rare(counts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, 2_000_000):
                held = [(i, h) for i, h in zip(ids[a:b], windows([normal(t) for t in texts[a:b]])) if h is not None]
                keys = [rare_keys(h, counts.value) for _, h in held]
                # no other text holds a window that was counted once
                places = [np.flatnonzero(counts.value[_slot(k)] > 1).astype(np.int32) for k in keys]
                keys = [k[p] for k, p in zip(keys, places)]
                size = np.array([len(k) for k in keys], np.int64)
                if not size.any():
                    continue
                places = np.concatenate(places)
                owners = np.repeat(np.array([i for i, _ in held], np.int64), size)
                of = np.repeat(np.array([len(h) for _, h in held], np.int32), size)
                found = [pa.array(owners), pa.array(np.concatenate(keys).view(np.int64)), pa.array(places), pa.array(of)]
                yield pa.RecordBatch.from_arrays(found, names=["id", "bucket", "place", "of"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text; keys and bits are empty where there are fewer than ``K`` words."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts, 2_000_000):
            plain = [normal(t) for t in texts[a:b]]
            # 128 bits stand for a text's words; texts without words stay apart by their id
            digest = [xxhash.xxh3_128_hexdigest(t) if t else f"-{i}" for t, i in zip(plain, ids[a:b].to_pylist())]
            sizes, keys, bits, held = [], [], [], []
            for h in windows(plain):
                if h is None:
                    sizes.append(0)
                    keys.append(None)
                    held.append(None)
                    bits.append(np.zeros(4, np.int64))
                    continue
                sizes.append(len(h))
                keys.append(np.concatenate([order_sketch(h), short_keys(h)]).view(np.int64))
                bits.append(bit_sketch(h))
                held.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(h) <= WINDOWS else None)
            four = np.stack(bits)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array(digest),
                    pa.array(np.array(sizes, np.int32)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(held, pa.list_(pa.int32())),
                    *[pa.array(np.ascontiguousarray(four[:, i])) for i in range(4)],
                ],
                names=["id", "digest", "n", "keys", "w", "b0", "b1", "b2", "b3"],
            )


def alignment(a: np.ndarray, b: np.ndarray, most: int) -> list[int] | None:
    """Lengths of the matched runs of a least-edit alignment, or None beyond ``most`` edits.

    Furthest points are kept for each diagonal of a band that widens by one a step; on a diagonal the next mismatch is
    looked up in a list made when the band first reaches it.
    """
    n, m = len(a), len(b)
    miss: dict[int, list[int] | np.ndarray] = {}

    def slide(k: int, i: int) -> int:
        """From a[i], b[i + k] along the diagonal to the first mismatch."""
        if k not in miss:
            lo, hi = max(0, -k), min(n, m - k)
            at = np.append(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo, hi) if hi > lo else np.array([lo])
            miss[k] = at.tolist() if n <= 4000 else at  # a list is faster, an array smaller
        at = miss[k]
        j = bisect_left(at, i)
        return max(i, int(at[j])) if j < len(at) else i

    reach = {0: slide(0, 0)}
    steps = [reach]
    while reach.get(m - n, -1) < n:
        if len(steps) > most:
            return None
        d, new = len(steps), {}
        for k in range(-d, d + 1):
            best = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -1))
            best = min(best, n, m - k)
            if best >= max(0, -k):
                new[k] = slide(k, best)
        reach = new
        steps.append(reach)
    runs, k, i = [], m - n, n
    for d in range(len(steps) - 1, 0, -1):
        old = steps[d - 1]
        _, start, k0 = max(
            ((s, s, q) for s, q in ((old.get(k, -2) + 1, k), (old.get(k + 1, -2) + 1, k + 1), (old.get(k - 1, -1), k - 1))), key=lambda x: x[0]
        )
        start = min(start, n, m - k)
        runs.append(i - start)
        i, k = old[k0], k0
    runs.append(i)
    return runs


def prepared(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its words as numbers, equal for equal words of this list, and its sorted labelled windows."""
    split = pc.split_pattern(pa.array([normal(t) for t in texts], pa.string()), " ")
    words = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return [(w, np.sort(kmers(w))) for w in np.split(words, ends[:-1])]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Five-word windows inside matched runs over all windows of both prepared texts; 0 where it can't reach ``SIMILARITY``."""
    (x, wx), (y, wy) = a, b
    if np.array_equal(x, y):
        return 1.0
    na, nb = len(x) - K + 1, len(y) - K + 1
    if na < 1 or nb < 1 or min(na, nb) < SIMILARITY * max(na, nb):
        return 0.0
    # an upper bound first: windows in common, whatever their order
    both = np.concatenate([wx, wy])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    if common < SIMILARITY * (na + nb - common):
        return 0.0
    # each edit spoils a window at least, and only this share of windows may be unmatched
    runs = alignment(x, y, int((1 - SIMILARITY) / (1 + SIMILARITY) * (na + nb)) + K)
    if runs is None:
        return 0.0
    held = sum(max(0, r - K + 1) for r in runs)
    return held / (na + nb - held)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts = batch.column(2).to_pylist()
        for lo, hi in chunks(firsts, 2_000_000):
            rows = batch.slice(lo, hi - lo).to_pydict()
            # a text of many pairs is prepared once
            texts = list(dict.fromkeys([*rows["ta"], *rows["tb"]]))
            ready = dict(zip(texts, prepared(texts)))
            kept = [(a, b) for a, b, s, t in zip(*rows.values()) if similarity(ready[s], ready[t]) >= SIMILARITY]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _may_link(x: str, y: str) -> Column:
    """Whether sizes, bit sketches and the windows of short texts allow a similarity of 0.8.

    At that similarity a range's minimum differs with a chance of at most 0.2 and then its bit in half of the cases; five
    standard deviations above that mean are let through. Short texts fill fewer ranges.
    """
    used = F.least(F.lit(BITS), F.col(f"{x}.n") + F.col(f"{y}.n")).cast("double")
    apart = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    # 0.8 of all windows of both are in common; one is allowed for, as two hashes of 32 bits in a text may be equal
    shared = F.size(F.array_intersect(f"{x}.w", f"{y}.w")) + 1 >= F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    both = F.col(f"{x}.w").isNull() | F.col(f"{y}.w").isNull() | shared
    return (small >= F.lit(SIMILARITY) * large) & (apart <= 0.1 * used + 1.5 * F.sqrt(used) + 2) & both


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    # an alignment is dear and a pair is small: tasks are sized by pairs, not bytes
    pairs = pairs.repartition(max(1, pairs.count() // PAIRS_PER_TASK), "a", "b")
    first, second = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return materialize(joined.mapInArrow(_verify, "a bigint, b bigint"), "links")


def classes(df: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(id_col, class_id, n_copies, verified_pairs) of each row with an id: class_id is the smallest id of its class.

    n_copies counts the rows with equal words. verified_pairs is how many pairs with that text were aligned and found similar; pairs already in
    one class are not compared, so it is no count of all links and depends on the order of comparing.
    Rows that repeat an id with another text are classed by their own text.
    """
    sketch, info, _ = _classed(df, id_col, column)
    return sketch.join(info, "digest").select(F.col("id").alias(id_col), "class_id", "n_copies", "verified_pairs")


def _classed(df: DataFrame, id_col: str, column: str) -> tuple[DataFrame, DataFrame, bool]:
    """(id, digest) of each row with an id, (digest, class_id, n_copies, verified_pairs) of each text, and whether an id has two texts.

    A text goes by the smallest id that has it; where an id has several texts, all but one of them go by a hash of the text below zero.
    """
    find_package(df.sparkSession)
    rows = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{column}`").cast("string").alias("text"))
    sketch = materialize(rows.mapInArrow(_sketches, _SKETCH), "sketch")
    per_id = sketch.groupBy("id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
    several = bool(per_id.filter("first < last").limit(1).count())
    texts = sketch.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    key = F.col("rep")
    if several:
        least = texts.groupBy("rep").agg(F.min("digest").alias("least"))
        texts = texts.join(least, "rep")
        key = F.when(F.col("digest") == F.col("least"), key).otherwise(-2 - F.shiftrightunsigned(F.xxhash64("digest"), 1))
    distinct = materialize(texts.select("digest", "rep", "n_copies", key.alias("key")), "distinct")
    own = sketch.filter("n > 0").join(distinct.select("digest", "key", F.col("rep").alias("id")), ["digest", "id"])
    if several:
        named = map_text(rows, "text", [("digest", "string")], _digests).join(distinct.select("digest", "key", F.col("rep").alias("id")), ["digest", "id"])
        rows = named.select(F.col("key").alias("id"), "text")
    # rows of one id and text are alike
    own = own.drop("digest", "id").withColumnRenamed("key", "id").dropDuplicates(["id"])
    labels, links = link_texts(own, rows)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("verified_pairs"))
    info = distinct.join(labels.withColumnRenamed("id", "key"), "key", "left").join(degree, "key", "left").withColumn("class_id", F.coalesce("label", "key"))
    if several:
        least = info.groupBy("class_id").agg(F.min("rep").alias("least"))
        info = info.join(least, "class_id").withColumn("class_id", F.col("least"))
    info = info.select("digest", "class_id", "n_copies", F.coalesce("verified_pairs", F.lit(0)).cast("bigint").alias("verified_pairs"))
    return sketch.select("id", "digest"), info, several


def _digest(text: str | None) -> str:
    plain = normal(text)
    return xxhash.xxh3_128_hexdigest(plain) if plain else ""


def _digests(texts: list[str | None]) -> list:
    return [[_digest(t) for t in texts]]


def link_texts(sketch: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, label) of linked texts and the links (a, b) found, for sketches of distinct texts and their rows (id, text)."""
    sketch = materialize(sketch, "distinct-sketch")
    # keys of short texts are of one table, whatever their place
    keyed = sketch.select("id", F.posexplode("keys").alias("t", "key")).withColumn("t", F.least("t", F.lit(TABLES)))
    keyed = keyed.select("id", "t", F.xxhash64("t", "key").alias("bucket"))
    lead = F.min_by("id", F.xxhash64("id", "bucket")).alias("lead")
    size = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), lead).filter("m > 1")
    met = materialize(keyed.join(size, "bucket"), "buckets")
    # only texts that meet another one are moved, once
    meeting = materialize(met.select("id").distinct(), "meeting")
    texts = materialize(rows.join(meeting, "id", "left_semi").dropDuplicates(["id"]), "texts")
    bits = materialize(sketch.drop("keys").join(meeting, "id", "left_semi"), "bits")
    star = met.filter((F.col("t") < STARS) & (F.col("id") != F.col("lead"))).select("id", "lead").distinct()
    star = star.join(bits.alias("x"), F.col("lead") == F.col("x.id")).join(bits.alias("y"), star["id"] == F.col("y.id")).filter(_may_link("x", "y"))
    pair = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    links = _links(materialize(star.select(*pair).distinct(), "pairs"), texts)
    labels = components(links)
    # keys of a small bucket have no order, so its texts meet whatever they share
    groups = met.filter(F.col("m") <= CROWD).select("bucket", "id", F.lit(0).alias("place"), "m")
    crowded = _mixed(met.filter(F.col("m") > CROWD).select("bucket", "id"), labels)
    crowd = materialize(texts.join(crowded.select("id").distinct(), "id", "left_semi"), "crowd")
    if crowd.limit(1).count():
        rare, labels, links = _by_rare_windows(crowd, bits, texts, labels, links)
        groups = groups.union(rare)
    return _settle(groups, bits, texts, labels, links)


def _labelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    return groups.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _mixed(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (bucket, id, ...) of groups of more than one class, with their labels; a group of one class has no pair left."""
    rows = _labelled(groups, labels)
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("bucket")
    return rows.join(mixed, "bucket", "left_semi")


def _pairs(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
    """The distinct pairs (a, b) of different classes that may be linked."""
    met = x.alias("x").join(y.alias("y"), on & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y"))
    return materialize(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "pairs")


def _may_share(x: str, y: str) -> Column:
    """Whether two texts may have 4 in 9 of the windows of both in common if all that is comes at or after these places; in whole numbers."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return most * 9 >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * 4


def _by_rare_windows(crowd: DataFrame, bits: DataFrame, texts: DataFrame, labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (bucket, id, place, m) by the rare windows of ``crowd``, which hold each pair of two texts that may be linked, and the labels
    and links after each has met the leader of its groups.

    If a pair's first shared window has the places i and j, what comes before is not in common; each group tests that bound as if its window
    were the first, which holds for one of them.
    """
    shared = crowd.sparkSession.sparkContext.broadcast(slot_codes(crowd))
    keyed = materialize(crowd.select("id", "text").mapInArrow(_rare(shared), "id bigint, bucket bigint, place int, of int"), "rare")
    # the text with the fewest windows of its own is likest to the others
    best = F.min_by(F.struct("id", "place"), F.struct("place", F.xxhash64("id"), "id"))
    # the smaller text of a pair shares 8 in 9 of its windows at least, so the first shared one is among its first n / 9 + 1
    early = F.col("place") * 9 <= F.col("of")
    sizes = F.min(F.when(early, F.col("of"))).alias("least"), F.max(F.when(early, F.col("of"))).alias("most")
    size = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), best.alias("lead"), *sizes).filter("m > 1 and least is not null")
    partner = early | ((F.col("least") <= F.col("of")) & (F.col("most") >= F.lit(SIMILARITY) * F.col("of")))
    met = materialize(keyed.join(size, "bucket").filter(partner).select("bucket", "id", "place", "m", "lead"), "rare-groups")
    rows = _mixed(met, labels).join(bits, "id")
    lead = _labelled(met.select(F.col("lead.id").alias("id"), F.col("lead.place").alias("place"), "bucket").distinct().join(bits, "id"), labels)
    found = _links(_pairs(lead, rows, (F.col("x.bucket") == F.col("y.bucket")) & _may_share("x", "y")), texts)
    return met.drop("lead"), *_joined(labels, links, found)


def _joined(labels: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and links with new links: a class so far counts as a star, its links need no second look."""
    if not found.limit(1).count():
        return labels, links
    stars = labels.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    return components(stars.union(found)), links.union(found)


def _settle(groups: DataFrame, bits: DataFrame, texts: DataFrame, labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and links after the members of all groups (bucket, id, place, m) have met, by rounds; see the head of this module.

    A text that leads in one of its groups leads in all of about their size. Members are dealt to parts of about ``SPREAD``, leaders go to each part.
    """
    draw = (F.shiftrightunsigned(F.xxhash64("id", F.lit("lead")), 11) / F.lit(float(1 << 53))) * F.col("m")
    parts = F.ceil(F.col("m") / SPREAD)
    groups = groups.withColumn("draw", draw).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts))
    low, high = 0.0, float(LEADERS)
    while True:
        # who led before has met all others
        now = _labelled(groups.filter(F.col("draw") >= low), labels)
        sizes = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
        outside = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("top"), (F.sum("k") - F.max("k")).alias("outside"))
        now = materialize(now.join(outside.filter("outside > 0"), "bucket").join(bits, "id"), "open")
        if not now.limit(1).count():
            return labels, links
        few = F.col("outside") <= SMALL
        lead = now.filter((few & (F.col("label") != F.col("top"))) | (~few & (F.col("draw") < high)))
        lead = lead.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") == F.col("y.part")) & _may_share("x", "y")
        labels, links = _joined(labels, links, _links(_pairs(lead, now, on), texts))
        groups = now.filter(~few).select("bucket", "id", "place", "m", "draw", "part")
        if not groups.limit(1).count():
            return labels, links
        low, high = high, high * LEADERS


def keep_first(df: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """``df`` without the rows whose class has a smaller id, each judged by its own text. Rows without an id stay.

    Up to ``BROADCAST_ROWS`` dropped ids are sent to the texts, so that these stay where they are; more are joined by a shuffle.
    """
    sketch, info, several = _classed(df, id_col, column)
    gone = sketch.join(info, "digest").filter(F.col("id") != F.col("class_id")).select(F.col("id").alias("_gone"), F.col("digest").alias("_gone_text")).distinct()
    own = F.col(f"`{id_col}`").cast("bigint") == F.col("_gone")
    if not several:
        gone = materialize(gone.select("_gone"), "gone")
        return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, own, "left_anti")
    digest = free_name(df, "digest_of_text")
    named = map_text(df, column, [(digest, "string")], _digests)
    return named.join(materialize(gone, "gone"), own & (F.col(digest) == F.col("_gone_text")), "left_anti").drop(digest)
