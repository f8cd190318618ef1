"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The k-mers of a text are its windows of ``SHINGLE`` lower-cased words, each labelled with the number of its occurrence. Each of ``SKETCHES`` hash
functions picks the ``MINIMA`` k-mers of smallest hash, and the sketch is a hash of these k-mers in the order of the text: it is equal for two texts
if the same k-mers win and stand in the same order, so it follows edit similarity and not only shared content. At a similarity of 0.8 a sketch agrees
with a chance of about 0.8 ** MINIMA; all of SKETCHES fail with one below 1e-9.

Texts are told apart by content: equal word sequences are one node, whatever ids their rows have. Candidates come in two rounds, between nodes only:

1. every sketch bucket has a leader, the text that meets most others over all its buckets; each text is compared with the leader it shares most
   buckets with, which needs one comparison per text however large a bucket is. What many copies were made from is such a leader;
2. texts whose buckets still hold several components of the links found are joined by their rarest windows. Windows that one component alone holds can't
   be part of what two components share, so they come first in the order of rarity, the others by how many texts hold them. Two texts of n and m windows
   within the threshold t have t / (1 + t) (n + m) in common, so one of the first n - t / (1 + t) (n + m) + 1 windows of each is in both. Keys hold the window and
   the classes of both lengths, since the bound depends on these. A copy with too many changes of its own has no window left to be found by: it meets
   nobody, where a bucket would make it meet all the others. Of two texts that meet, the parities of their windows, dealt to ``PARITIES`` bits, differ in no more
   bits than windows are in one text only; where these are too many the pair is not emitted. Both bounds are exact: nothing is capped and no link is left out.

Verification aligns the two word sequences (greedy furthest-reaching alignment, its band set by how many edits the threshold still allows) and
counts the windows kept in order: similarity is kept / (windows of a + windows of b - kept), and a link needs ``THRESHOLD``. Links join texts to classes;
one row of a class stays, that with the largest id.

Defined results: null and empty texts, and texts without a word, are equal to one another; texts of fewer words than a window match equal ones only; case
and the kind of white space don't matter. Rows are compared by their texts alone: rows without an id, with repeated ids, or repeated as a whole are rows like any
other. A null id counts as the smallest; of rows with the same largest id one stays (that of the larger hash of the text, then an arbitrary one). A class whose rows have
no id has a null class_id. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, materialise, whole_text
from .components import components

SHINGLE = 5
SKETCHES = 32
MINIMA = 3
THRESHOLD = 0.8
#: Ratio of the bounds of a class of lengths.
LENGTH_CLASS = 1.04
PARITIES = 512
CACHED_WORDS = 300_000
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)


class _Words(dict):
    """32-bit hashes of words, kept in bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")
        return h


def word_hashes(text: str | None, cache: dict) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint32, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows; a shorter text is one window."""
    if not len(words):
        return np.zeros(0, np.uint64)
    w = words.astype(np.uint64)
    width = min(SHINGLE, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mix(h + w[i : len(w) - width + 1 + i])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """The windows with the number of their occurrence mixed in."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    start = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if start.all():
        return h
    at = np.arange(len(h))
    nth = np.empty(len(h), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(start, at, 0))
    return _mix(h + nth * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES signed 64-bit sketches; none for a text without a word."""
    h = shingles(words)
    if not len(h):
        return np.zeros(0, np.int64)
    label = labelled(h)
    few = min(MINIMA, len(h))
    values = _mix(label[None, :] ^ _SEEDS[:, None])
    each = np.arange(SKETCHES)
    least = np.empty((SKETCHES, few), np.int64)
    for i in range(few):
        least[:, i] = at = values.argmin(axis=1)
        values[each, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least.sort(axis=1)  # text order
    out = _SEEDS.copy()
    for i in range(few):
        out = _mix(out + h[least[:, i]])
    return out.view(np.int64)


def kept_windows(a: list[int], b: list[int], most_edits: int) -> int:
    """Windows of both sequences that an alignment with at most ``most_edits`` insertions and deletions keeps; -1 beyond that."""
    n, m = len(a), len(b)
    windows = lambda run: max(0, run - SHINGLE + 1)
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    if head == n and head == m:
        return windows(n)
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    # per diagonal: how far in a, windows so far, length of the run of matches that reaches here
    reach: dict[int, tuple[int, int, int]] = {1: (0, windows(head), head)}
    for d in range(most_edits + 1):
        for k in range(-min(d, m), min(d, n) + 1):
            if (k + d) % 2:
                continue
            left, right = reach.get(k - 1), reach.get(k + 1)
            if d == 0:
                x, kept, run = reach[1]
            elif right is not None and (k == -d or left is None or left[0] < right[0]):
                x, kept, run = right[0], right[1], 0
            elif left is not None:
                x, kept, run = left[0] + 1, left[1], 0
            else:
                continue
            y, begun = x - k, run
            if x > n or y > m or y < 0:
                continue
            while x < n and y < m and a[x] == b[y]:
                x, y, run = x + 1, y + 1, run + 1
            kept += windows(run) - windows(begun)
            reach[k] = (x, kept, run)
            if x >= n and y >= m:
                return kept + windows(run + tail) - windows(run)
    return -1


#: Windows from which on an alignment, quadratic in the edits, is worth the bound below first.
LONG = 1000


def most_in_order(sa: np.ndarray, sb: np.ndarray) -> int:
    """No alignment keeps more windows than this: those that stand once in each text rise in both where they are kept, so no more of them than the longest rise; of others all that are common."""
    (ua, ia, ca), (ub, ib, cb) = (np.unique(s, return_index=True, return_counts=True) for s in (sa, sb))
    _, at, bt = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    once = (ca[at] == 1) & (cb[bt] == 1)
    tails: list[int] = []
    for j in ib[bt[once]][np.argsort(ia[at[once]])].tolist():
        k = bisect.bisect_left(tails, j)
        tails[k : k + 1] = [j]
    return len(tails) + int(np.minimum(ca[at], cb[bt])[~once].sum())


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of windows kept in order; 0 where the threshold is out of reach."""
    na, nb = max(1, len(a) - SHINGLE + 1), max(1, len(b) - SHINGLE + 1)
    if len(a) < SHINGLE or len(b) < SHINGLE:
        return float(len(a) == len(b) and bool((a == b).all()))
    need = int(np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9))
    if need > min(na, nb):
        return 0.0
    # windows in common, whatever their order, bound those kept in order
    if len(np.intersect1d(labelled(shingles(a)), labelled(shingles(b)))) < need:
        return 0.0
    if min(na, nb) > LONG and most_in_order(shingles(a), shingles(b)) < need:
        return 0.0
    kept = kept_windows(a.tolist(), b.tolist(), len(a) + len(b) - 2 * (need + SHINGLE - 1))
    return kept / (na + nb - kept) if kept >= need else 0.0


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id, and a hash of the text, which together tell rows apart that aren't repeated as a whole."""
    return F.col(id_col).cast("long"), F.xxhash64(F.lit("doc"), whole_text(text_col))


def content(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text) of every row, see row_key."""
    own_id, own_doc = row_key(id_col, text_col)
    return docs.select(own_id.alias("id"), own_doc.alias("doc"), F.col(text_col).alias("text"))


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, doc, key (128 bits of the word sequence, as binary), n (words) and sketches of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for x in batch.column("text"):
                words = (x.as_py() or "").lower().split()
                keys.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
                sizes.append(len(words))
                sketches.append(order_sketches(np.fromiter(map(cache.__getitem__, words), np.uint32, len(words))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("doc"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "doc", "key", "n", "sketches"]
            )

    return content(docs, id_col, text_col).mapInArrow(run, "id long, doc long, key binary, n int, sketches array<long>")


def word_sequences(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, words as packed 32-bit hashes) of nodes (node, id, doc), each read from a row with its id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            packed = [word_hashes(x.as_py(), cache).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "words"])

    wanted = nodes.select("node", F.col("id").alias("_id"), F.col("doc").alias("_doc"))
    rows = content(docs, id_col, text_col).join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc"))).select("node", "text")
    return rows.mapInArrow(run, "node long, words binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v), those whose alignment reaches the threshold, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), threshold) for a, b in zip(batch.column("a"), batch.column("b"))]
            whole = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found, pa.float64())], names=["u", "v", "similarity"])
            yield whole.filter(pa.array([x > 0 for x in found], pa.bool_()))

    both = pairs.join(sequences.select(F.col("node").alias("u"), F.col("words").alias("a")), "u").join(sequences.select(F.col("node").alias("v"), F.col("words").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, similarity double")


def parities(windows: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of windows falls to each bit, as longs."""
    odd = np.bincount((_mix(windows) >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_windows(sequences: DataFrame) -> DataFrame:
    """(node, component, n, windows, bits): the labelled windows of sequences (node, component, words) of a window or more, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled(shingles(np.frombuffer(x.as_py(), np.uint32))) for x in batch.column("words")]
            lists = [pa.array([f(x) for x in found], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), parities)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), pa.array(map(len, found), pa.int32()), *lists], names=["node", "component", "n", "windows", "bits"])

    long_enough = sequences.where(F.octet_length("words") >= 4 * SHINGLE).select("node", "component", "words")
    return long_enough.mapInArrow(run, "node long, component long, n int, windows array<long>, bits array<long>")


def rare_window_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of nodes of different components that may reach the threshold; texts as of node_windows. No pair that reaches it is left out.

    What leaves is bounded per text by its windows times the classes of lengths within the threshold of its own, about 12 of them.
    """
    step = F.lit(float(np.log(LENGTH_CLASS)))
    length_class = lambda n: F.floor(F.log(n.cast("double")) / step).cast("int")
    need = lambda n, m: F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)
    each = texts.select("node", "component", F.explode("windows").alias("w"))
    spread = each.groupBy("w").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("w", "held")
    ranked = each.select("node", "w").join(spread, "w").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "w"))).alias("ranked"))
    own = ranked.join(texts.select("node", "component", "n", "bits"), "node").withColumn("shared", F.size("ranked")).where(F.col("shared") >= F.ceil(F.col("n") * threshold - 1e-9))
    least, most = F.ceil(F.col("n") * threshold - 1e-9), F.floor(F.col("n") / threshold + 1e-9)
    # a class may begin one below its bound as rounded here; a longer prefix loses nothing
    partner = F.greatest(F.ceil(F.pow(F.lit(LENGTH_CLASS), F.col("partner"))) - 1, least)
    by_class = own.withColumn("class", length_class(F.col("n"))).withColumn("partner", F.explode(F.sequence(length_class(F.greatest(least - 1, F.lit(1))), length_class(most + 1))))
    prefix = by_class.withColumn("prefix", (F.col("shared") - need(F.col("n"), partner) + 1).cast("int")).where("prefix > 0")
    bits = [F.col("bits")[i].alias(f"bits{i}") for i in range(PARITIES // 64)]
    keys = prefix.select("node", "component", "n", "bits", "shared", "class", "partner", F.posexplode(F.slice("ranked", 1, F.col("prefix"))).alias("at", "x")).select(
        F.xxhash64("x.w", F.least("class", "partner"), F.greatest("class", "partner")).alias("k"), "node", "component", "n", (F.col("shared") - F.col("at")).alias("left"), F.signum(F.col("partner") - F.col("class")).cast("int").alias("side"), *bits
    )
    # under a key of two classes those of the one meet those of the other
    mixed = keys.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), (F.min("side") + F.max("side")).alias("sides")).where("lo < hi AND sides = 0").select("k")
    keys = materialise(keys.join(mixed, "k"), "rare")
    a, b = (keys.select(*(F.col(c).alias(f"{side}_{c}") for c in keys.columns)) for side in "ab")
    common = need(F.col("a_n"), F.col("b_n"))
    # after the first window in common, no more can follow than either has left
    within = (F.col("a_side") + F.col("b_side") == 0) & (F.least("a_left", "b_left") >= common)
    differ = sum(F.bit_count(F.col(f"a_bits{i}").bitwiseXOR(F.col(f"b_bits{i}"))) for i in range(len(bits)))
    within = within & (differ <= F.col("a_n") + F.col("b_n") - 2 * common)
    met = a.join(b, (F.col("a_k") == F.col("b_k")) & (F.col("a_node") > F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & within)
    return met.groupBy(F.col("a_node").alias("u"), F.col("b_node").alias("v")).agg(F.count(F.lit(1)).alias("_n")).select("u", "v")


def links(base: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, key, top, copies: one per distinct text), links (u, v, similarity) between nodes, and (id, component) of linked nodes."""
    texts = base.groupBy("key").agg(F.max(F.struct("id", "doc", "row")).alias("top"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sketches").alias("sketches"))
    nodes = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are settled once they are written
    bands = nodes.select("node", F.explode("sketches").alias("sketch"))
    buckets = bands.groupBy("sketch").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(bands.join(buckets, "sketch"), "buckets")
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    leaders = shared.join(reach, "node").groupBy("sketch").agg(F.max(F.struct("reach", F.col("node").alias("leader"))).alias("_l"))
    led = shared.join(leaders.select("sketch", F.col("_l.leader").alias("leader")), "sketch")
    best = led.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("agree")).groupBy("node").agg(F.max(F.struct("agree", "leader")).alias("best"))
    met = nodes.select("node", "top.id", "top.doc").join(shared.select("node").distinct(), "node", "left_semi")
    sequences = materialise(word_sequences(docs, met, id_col, text_col), "sequences")
    tried = materialise(best.select(F.greatest("node", "best.leader").alias("u"), F.least("node", "best.leader").alias("v")).distinct(), "pairs")
    found = materialise(verified(tried, sequences, threshold), "links")

    joined = components(found)
    held = shared.join(joined.withColumnRenamed("id", "node"), "node", "left").select("sketch", "node", F.coalesce("component", "node").alias("component"))
    mixed = held.groupBy("sketch").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sketch")
    apart = held.join(mixed, "sketch").groupBy("node").agg(F.first("component").alias("component"))
    texts = materialise(node_windows(sequences.join(apart, "node")), "windows")
    pairs = rare_window_pairs(texts, threshold).join(tried, ["u", "v"], "left_anti")
    more = materialise(verified(pairs, sequences, threshold), "links")
    stars = joined.select(F.col("id").alias("u"), F.col("component").alias("v"))
    placed = components(stars.unionByName(more.select("u", "v")))
    discard(shared, tried, sequences, texts, joined)
    return nodes, found.unionByName(more), placed


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, class_id, class_size, n_links, kept) of every row."""
    sketches = sketched(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    base = materialise(sketches, "sketched")
    nodes, found, placed = links(base, docs, threshold, id_col, text_col)
    degree = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("key", "node", "top", "copies").join(placed.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    sizes = known.groupBy("component").agg(F.max("top").alias("stays"), F.sum("copies").alias("class_size")).where("class_size > 1")
    classes = known.join(sizes, "component").select("key", "stays", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return base.select("id", "doc", "row", "key").join(classes, "key", "left").select(
        "id", "doc", F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("class_id"),
        F.coalesce("class_size", one).alias("class_size"), F.coalesce("n_links", none).alias("n_links"), F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (largest id of the class), class_size, n_links and kept of every row; one row of a class is kept.

    n_links counts the verified links that classes were built from: those with the text's leader and those across the first round's components. Pairs
    inside a component are never compared, so it is not the number of texts that the document is similar to.
    """
    return _classes(docs, threshold, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", "kept")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; of rows that repeat an id and a text one stays, whichever."""
    rows = _classes(docs, threshold, "doc_id", "text").where("class_size > 1")
    fate = rows.groupBy("id", "doc").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_rows")).where("NOT _stays OR _rows > 1")
    fate_id, fate_doc, stays, of_id, of_doc = free_names(docs, "_id", "_doc", "_stays", "_own_id", "_own_doc")
    fate = materialise(fate.select(F.col("id").alias(fate_id), F.col("doc").alias(fate_doc), F.col("_stays").alias(stays)), "fate")
    own_id, own_doc = row_key("doc_id", "text")
    mine = own_id.eqNullSafe(F.col(fate_id)) & (own_doc == F.col(fate_doc))
    rest = docs.join(fate, mine, "left_anti")
    repeated = fate.where(F.col(stays))
    if repeated.isEmpty():
        return rest
    once = docs.select(F.struct("*").alias("_row"), own_id.alias(of_id), own_doc.alias(of_doc)).join(repeated, F.col(of_id).eqNullSafe(F.col(fate_id)) & (F.col(of_doc) == F.col(fate_doc)), "left_semi")
    return rest.unionByName(once.groupBy(of_id, of_doc).agg(F.first("_row").alias("_row")).select("_row.*"))
