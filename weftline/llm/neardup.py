"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its windows of k words, each labelled with its occurrence number. A sketch takes
the ORDER least k-mers under its own hash and keeps them in text order, so equal sketches mean shared
k-mers in the same order, which follows edit similarity more closely than a set does. Texts that share
a key meet in a bucket, and links are verified by alignment over words: a link is a similarity of
SIMILARITY or more.

Windows are three words: a changed word spoils three of them at most, so wherever a fifth of the words
is changed two fifths of the windows stay, a Jaccard of a quarter, and two such texts share none of 96
sketches of two windows with probability (1 - 1/16)**96 = 0.002. Five words give no such bound: with every fifth
word changed each window holds one, and all links of that kind were lost. Texts under 25 words have
windows of two; lengths of the classes overlap by as much as those of similar texts may differ, so each
similar pair has a class in common. Texts of up to EXACT words have no sketches but exact keys: all that is
left of them after as many deletions as a similar text may differ by, so of two such texts no link is lost.

In each bucket, cut by overlapping length classes, every text is compared with one hub, the least.
Buckets of one hub are one group. Of a group that its hub leaves in several components, the rest is
listed in blocks: each member outside the hub's component meets every member of another component, by
its bag of words first; texts are sent for members that are near to another component, and such pairs
are verified unless links found before join them. So
classes are the components of all similar pairs that share a bucket, and a text is sent once for each of
its groups, however many keys it shares there. Exact copies are one node, so a group of copies costs one sketch,
and no pairs are listed within a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_ROWS, discard, free, ship, spread_join, staged
from weftline.llm.components import components
from weftline.llm.wordhash import mix64, word_hashes

ORDER = 2
#: Least and most words of a text, words of a window, sketches.
CLASSES = ((12, 24, 2, 48), (20, 1 << 62, 3, 96))
#: Texts of up to this many words have exact keys.
EXACT = 14
#: Ranks of k-mers held at once.
RANKS = 1 << 20
#: Least share of words that an alignment keeps: 1 - edits / words of the longer text.
SIMILARITY = 0.8
#: Counts in a bag of words; members of an open group that a block holds.
BAG, BLOCK = 256, 1024
#: Counts in the wider bag that pairs of a block must pass before they are aligned.
WIDE_BITS = 12
#: Rows of a batch that are Python objects at a time.
SLICE = 256
#: Members that meet one copy of a hub's text in a task.
HUB_SHARE = 64


def order_sketches(h: np.ndarray, k: int, sketches: int) -> np.ndarray:
    """One key for each sketch of a text's word hashes; none for a text of fewer than k words."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    grams = np.full(n, k, np.uint64)
    for i in range(k):
        grams = mix64(grams * np.uint64(31) + h[i : i + n])
    by = np.argsort(grams, kind="stable")
    in_order = grams[by]
    fresh = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    at = np.arange(n)
    label = np.empty(n, np.uint64)
    label[by] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    grams = mix64(grams + label * np.uint64(0xD1342543DE82EF95))
    seeds = mix64(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    odd = mix64(seeds) | np.uint64(1)
    keys = []
    for start in range(0, sketches, max(1, RANKS // n)):
        some = slice(start, start + max(1, RANKS // n))
        ranks = (grams[None, :] ^ seeds[some, None]) * odd[some, None]
        first = ranks.argmin(axis=1)
        ranks[np.arange(len(ranks)), first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = ranks.argmin(axis=1)
        low, high = grams[np.minimum(first, second)], grams[np.maximum(first, second)]
        keys.append(mix64(mix64(low + seeds[some]) * np.uint64(3) + high))
    return np.concatenate(keys).view(np.int64)


def most_edits(words: int, similarity: float = SIMILARITY) -> int:
    """Edits that a similar pair may have whose longer text has so many words."""
    return int((1 - similarity) * words + 1e-9)


@lru_cache(maxsize=64)
def _left_over(n: int, gone: int) -> np.ndarray:
    """Places that are left of n after ``gone`` deletions, a row for each way."""
    return np.array(list(combinations(range(n), n - gone)), np.int64).reshape(-1, n - gone)


def exact_keys(h: np.ndarray) -> np.ndarray:
    """Keys of all that is left of a short text after as many deletions as it may have edits.

    Of two texts within d edits, of which the longer has n more words, the longer is left with what the
    shorter is left with after at most d and d - n deletions, and neither is more than its own most_edits.
    """
    out = []
    for gone in range(most_edits(len(h)) + 1):
        places = _left_over(len(h), gone)
        key = np.full(len(places), 0x5851F42D4C957F2D, np.uint64)
        for i in range(places.shape[1]):
            key = mix64(key * np.uint64(31) + h[places[:, i]])
        out.append(key)
    return np.concatenate(out).view(np.int64)


def candidate_keys(h: np.ndarray) -> np.ndarray:
    """All keys of a text's word hashes, each once; none for a text without words."""
    made = [order_sketches(h, k, sketches) for least, most, k, sketches in CLASSES if least <= len(h) <= most]
    if 0 < len(h) <= EXACT:
        made.append(exact_keys(h))
    return np.unique(np.concatenate(made)) if made else np.zeros(0, np.int64)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two word lists if it is ``most`` at most, else ``most`` + 1.

    Only the diagonals within ``most`` of the main one are kept, as one bit vector that slides down the
    band (the bit-parallel recurrence of Myers in Hyyrö's banded form).
    """
    if len(a) < len(b):
        a, b = b, a
    front = 0
    while front < len(b) and a[front] == b[front]:
        front += 1
    back = 0
    while back < len(b) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    k = min(most, m)
    full, bottom = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    spots: dict = {}
    for i, w in enumerate(a):
        spots[w] = spots.get(w, 0) | (1 << i)
    up, down, at, edge = ((1 << (k + 1)) - 1) << k, 0, k, bottom >> 1
    for i, w in enumerate(b):
        seen = spots.get(w, 0)
        eq = (seen >> (i - k) if i >= k else seen << (k - i)) & full
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = (down | ~(diag | up)) & full, diag & up
        if i < m - k:
            at += not diag & bottom
            if at - (n - i) > k + (m - n):
                return most + 1
        else:
            at += bool(right & edge) - bool(left & edge)
            edge >>= 1
        slid = diag >> 1
        up, down = (left | ~(slid | right)) & full, right & slid
    return at if at <= most else most + 1


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    x, y = a.lower().split(), b.lower().split()
    most = most_edits(max(len(x), len(y)), similarity)
    return banded_distance(x, y, most) <= most


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            part = whole.slice(start, SLICE)
            words = [t.lower().split() for t in part.column("text").to_pylist()]
            hashes = [word_hashes(w) for w in words]
            made = [pa.array([len(w) for w in words], pa.int32()), pa.array([candidate_keys(h) for h in hashes], pa.list_(pa.int64())), pa.array([word_bag(h).tobytes() for h in hashes], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "hash", "row")), *made], ["doc_id", "hash", "row", "n_words", "keys", "bag"])


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bags of words are as near as those of a similar pair must be."""
    for part in batches:
        if part.num_rows:
            sizes = np.maximum(*(part.column(c).to_numpy().astype(np.int64) for c in ("n_words", "hub_words")))
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for c in ("bag", "hub_bag"))
            above, below = (np.maximum(x, 0).sum(axis=1) for x in (a - b, b - a))
            near = np.maximum(above, below) <= ((1 - SIMILARITY) * sizes + 1e-9).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("hub"), part.column("member")], ["hub", "member"]).filter(pa.array(near))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt), a hub's own text before those of its members."""
    hub_text = None
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            found = []
            for hub, node, text in zip(*(whole.slice(start, SLICE).column(c).to_pylist() for c in ("hub", "node", "text")), strict=True):
                if node == hub:
                    hub_text = text
                else:
                    found.append((hub, node, similar(hub_text, text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["hub", "member", "linked"])


def word_bag(h: np.ndarray) -> np.ndarray:
    """Counts of a text's word hashes, cut at 255. What one bag has more than the other, on either side, is no more than the edit distance."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BAG), 255).astype(np.uint8)


def wide_bag(h: np.ndarray) -> np.ndarray:
    """As word_bag, of 2**WIDE_BITS counts."""
    return np.minimum(np.bincount((h >> np.uint64(64 - WIDE_BITS)).astype(np.int64), minlength=1 << WIDE_BITS), 65535).astype(np.uint16)


def _meetings(t: pa.Table, bags: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row of a block with the columns of another root whose bags are near enough, and the edits that they may have."""
    node, side, minor = (np.array(t.column(c).to_pylist()) for c in ("node", "row_side", "minor"))
    kind = t.column("root").to_numpy()
    cols = np.flatnonzero(~side)
    for r in np.flatnonzero(side):
        # Two members outside the hub's component meet twice; the lesser's row counts.
        met = cols[(kind[cols] != kind[r]) & (~minor[cols] | (node[cols] > node[r]))]
        most = ((1 - SIMILARITY) * np.maximum(sizes[met], sizes[r]) + 1e-9).astype(np.int64)
        met, most = met[sizes[met] - sizes[r] <= most], most[sizes[met] - sizes[r] <= most]
        near = _apart(bags, met, r) <= most
        yield int(r), met[near], most[near]


def _apart(bags: np.ndarray, met: np.ndarray, r: int) -> np.ndarray:
    """What bag ``r`` and each of ``met`` have more than the other, on the side where that is more."""
    common = np.minimum(bags[met], bags[r]).sum(axis=1, dtype=np.int64)
    return np.maximum(bags[met].sum(axis=1, dtype=np.int64), bags[r].sum(dtype=np.int64)) - common


def _block_hopes(t: pa.Table) -> pa.RecordBatch:
    """Members of one block that are near to another component by their bags."""
    bags = np.frombuffer(b"".join(t.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
    found = {i for r, met, _ in _meetings(t, bags, t.column("n_words").to_numpy().astype(np.int64)) if len(met) for i in (r, *met.tolist())}
    some = t.take(pa.array(sorted(found), pa.int64())).combine_chunks()
    return pa.RecordBatch.from_arrays([some.column(c).combine_chunks().cast(pa.int64()) for c in ("key", "node")], ["key", "node"])


def _block_links(t: pa.Table) -> pa.RecordBatch:
    """Links of one block: rows meet columns of another root, in the least group that both are in."""
    key, nodes, text, root = (t.column(c).to_pylist() for c in ("key", "node", "text", "root"))
    keys = [set(k) for k in t.column("keys").to_pylist()]
    up = {r: r for r in root}

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    # Words are split again for near pairs only, so a block's words aren't held together.
    sizes, bags, wide = np.zeros(len(text), np.int64), np.zeros((len(text), BAG), np.uint8), np.zeros((len(text), 1 << WIDE_BITS), np.uint16)
    for i, x in enumerate(text):
        h = word_hashes(x.lower().split())
        sizes[i], bags[i], wide[i] = len(h), word_bag(h), wide_bag(h)
    found = []
    for r, met, most in _meetings(t, bags, sizes):
        near = _apart(wide, met, r) <= most  # of texts of many words, BAG counts leave most unlike pairs
        for m, k in zip(met[near].tolist(), most[near].tolist(), strict=True):
            a, b = find(root[r]), find(root[m])
            if a != b and min(keys[r] & keys[m]) == key[r] and banded_distance(text[r].lower().split(), text[m].lower().split(), k) <= k:
                up[a] = b
                found.append((nodes[r], nodes[m]))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _by_block(handle: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``handle`` on each block of rows sorted by (key, col, row)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in parts:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            ids = np.stack([t.column(c).to_numpy() for c in ("key", "col", "row")])
            starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
            for start, end in zip(starts, starts[1:], strict=False):
                yield handle(t.slice(start, end - start))
            rest = t.slice(starts[-1])
        if rest is not None:
            yield handle(rest)

    return batches


def _open_groups(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, minor, cols, rows) of the members of groups in several components: minor ones are outside the hub's, and blocks cut all and minor members.

    The hub itself is left out, as it has met every member.
    """
    grouped = pairs.toDF("key", "node").unionByName(pairs.select(F.col("hub").alias("key"), F.col("hub").alias("node")).distinct())
    labelled = grouped.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    each = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    mixed = each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min_by("root", "low").alias("main"), F.min_by("n", "low").alias("n_main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.where("n > 2 and kinds > 1").select("key", "main", blocks(F.col("n") - 1).alias("cols"), blocks(F.col("n") - F.col("n_main")).alias("rows"))
    members = labelled.where("node != key").join(mixed, "key")
    return staged(members.select("key", "node", "root", (F.col("root") != F.col("main")).alias("minor"), "cols", "rows"), "nd-open")


def _hopeful(unsure: DataFrame, hopes: DataFrame) -> DataFrame:
    """The rows of ``unsure`` in ``hopes`` (key, node), with the blocks of what is left."""
    some = unsure.drop("cols", "rows").join(hopes, ["key", "node"])
    count = some.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cols"), F.ceil(F.count_if(F.col("minor")) / BLOCK).cast("int").alias("rows"))
    return staged(some.join(count.where("rows > 0"), "key"), "nd-some")


def _blocks(sized: DataFrame, known: DataFrame) -> DataFrame:
    """Members of open groups, with what is ``known`` of a node, dealt and sorted by blocks.

    Members outside the hub's component are rows, all members are columns, and blocks cut both, so a
    large group with few such members costs little more than its size. A group of many unlike members
    costs a comparison of bags for each pair of them.
    """
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    kept = ["key", "node", "root", "minor"]
    columns = sized.withColumn("row", every("rows")).select(*kept, place("cols").alias("col"), "row", F.lit(False).alias("row_side"))
    meeting = sized.where("minor").withColumn("col", every("cols")).select(*kept, "col", place("rows").alias("row"), F.lit(True).alias("row_side"))
    dealt = columns.unionByName(meeting).join(known, "node")
    return dealt.repartition("key", "col", "row").sortWithinPartitions("key", "col", "row")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, member) to (hub, member, linked). A hub's text is copied for every HUB_SHARE members, and dealt with them.

    Where each text goes is told by ids first, so texts meet in one shuffle; few ids are broadcast, and no other shuffle holds texts.
    """
    pairs = pairs.join(pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("salts")), "hub")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    hubs = pairs.groupBy("hub").agg(F.max("salts").alias("salts")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    places = salted.select(F.col("member").alias("node"), "hub", "salt").unionByName(hubs.select(F.col("hub").alias("node"), "hub", "salt"))
    sent = texts.join(_few(staged(places, "nd-places")), "node").select("hub", "salt", "node", "text")
    met = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"))
    return met.mapInArrow(_verify_batches, "hub long, member long, linked boolean")


def _named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(hash, class_id, copies, class_md5) of every node. The class is named by its least (doc_id, hash), null ids last."""
    hexed = lambda c: F.lower(F.hex(c))
    linked = nodes.join(roots, "node")
    names = staged(linked.groupBy("root").agg(F.min(F.struct("first", "hash")).alias("name"), F.count("*").alias("n")), "nd-names")
    named = spread_join(linked.select("hash", "copies", "root"), names, "root", "n")
    named = named.select("hash", F.col("name.first.id").alias("class_id"), "copies", hexed("name.hash").alias("class_md5"))
    alone = nodes.join(roots, "node", "left_anti").select("hash", F.col("first.id").alias("class_id"), "copies", hexed("hash").alias("class_md5"))
    return named.unionByName(alone)


def _few(nodes: DataFrame) -> DataFrame:
    """Staged ``nodes``, to be broadcast if they are few."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes


def _texts(plain: DataFrame, some: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``some``. Few are broadcast, so texts that aren't wanted stay where they are; more are joined."""
    some = _few(staged(some.distinct(), "nd-some-nodes"))
    wanted = _few(staged(nodes.join(some, "node").select("node", "copies", F.col("first.id").alias("id"), F.col("hash").alias("of")), "nd-wanted"))
    found = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["id"]) & (plain["hash"] == wanted["of"])).select("node", "text", "copies")
    # Only a text with copies can have several rows of one id.
    found = staged(found, "nd-texts")
    once = found.where("copies > 1").select("node", "text").dropDuplicates(["node"])
    return found.where("copies = 1").select("node", "text").unionByName(once)


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows of ``buckets`` (node, n_words, key) whose key another node has. Neighbours in the order of keys tell, so rows are shuffled once and no group is counted first."""
    by_key = Window.partitionBy("key").orderBy("node")
    beside = buckets.withColumns({"_before": F.lag("node").over(by_key), "_after": F.lead("node").over(by_key)})
    return beside.where("_before is not null or _after is not null").drop("_before", "_after")


def _met(buckets: DataFrame) -> DataFrame:
    """(hub, member) of ``buckets`` (key, node, c): in a key's length classes c and c + 1 every node meets the least.

    A class lies within its key, so all is done where the key's rows have been dealt and sorted; only pairs are shuffled again.
    """
    cut = _shared(buckets).select("key", "node", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("c"))
    so_far = Window.partitionBy("key", "c").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.withColumn("hub", F.min("node").over(so_far)).where("node != hub")
    return met.select("hub", F.col("node").alias("member")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """(node) of ``pairs``: hubs, few for many pairs, and members; a node may come twice."""
    return pairs.select(F.col("hub").alias("node")).distinct().unionByName(pairs.select(F.col("member").alias("node")).distinct())


def _bags(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n_words, bag) of the nodes in ``pairs``."""
    wanted = _few(staged(_ends(pairs).distinct(), "nd-ends"))
    return staged(rows.select(F.col("row").alias("node"), "n_words", "bag").join(wanted, "node"), "nd-bags")


def _near_pairs(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``pairs`` (hub, member) without those that bags of words rule out, so fewer texts are sent."""
    hubs = pairs.groupBy(F.col("hub").alias("node")).agg(F.count("*").alias("n")).join(bags, "node")
    hubs = staged(hubs.select(F.col("node").alias("hub"), F.col("n_words").alias("hub_words"), F.col("bag").alias("hub_bag"), "n"), "nd-hubs")
    # Members come last: the join with hubs reads its rows twice if a hub is hot, so nothing but ids may stand before it.
    with_bags = spread_join(pairs, hubs, "hub", "n").join(bags.withColumnRenamed("node", "member"), "member")
    near = staged(with_bags.mapInArrow(_near_batches, "hub long, member long"), "nd-near")
    discard(hubs)
    return near


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Class of every document: doc_id, class_id, copies (rows of the same text), text_md5, class_md5; one row per input row.

    class_id is the least doc_id of the class, class_md5 the MD5 of the text it names. A null text counts as empty; texts without words match
    only equal texts. Null doc_ids belong to classes but name one only if all its ids are null; ids may
    have any type that has an order. Repeated rows are copies; other columns are ignored; an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    rows = staged(numbered.mapInArrow(_sketch_batches, f"doc_id {kind}, hash binary, row long, n_words int, keys array<long>, bag binary"), "nd-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    # A text's node is the number of one of its rows, so it is found again by a key that no other row has.
    nodes = staged(rows.groupBy("hash").agg(F.min("row").alias("node"), first, F.count("*").alias("copies")), "nd-nodes")
    # Copies are dropped from the candidates: few by broadcast, more by a join whose result is staged.
    more = staged(rows.select("row", "hash").join(nodes.where("copies > 1").select("hash", "node"), "hash").where("row != node").select("row"), "nd-more")
    mine = rows.where("n_words > 0").select("row", "n_words", "keys")
    if more.count() <= BROADCAST_ROWS:
        mine = mine.join(F.broadcast(more), "row", "left_anti")
    else:
        mine = staged(mine.join(more, "row", "left_anti"), "nd-mine")
    size_class = F.floor(F.log("n_words") / float(np.log(1 / SIMILARITY))).cast("byte")
    # Keys stand first and classes take a byte, as what follows a key is then often what followed the last one, which compresses.
    buckets = mine.select(F.explode("keys").alias("key"), F.col("row").alias("node"), size_class.alias("c"))
    pairs = staged(_met(buckets), "nd-pairs")
    bags = _bags(pairs, rows)
    near = _near_pairs(pairs, bags)
    checked = staged(_verified(near, _texts(plain, _ends(near), nodes)), "nd-checked")
    links = checked.where("linked").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    roots = components(links)
    # What hubs leave open: first by bags, then texts of those members that are near to another component.
    unsure = _open_groups(pairs, roots)
    hopes = staged(_blocks(unsure, bags).mapInArrow(_by_block(_block_hopes), "key long, node long").distinct(), "nd-hopes")
    discard(bags)
    if not hopes.isEmpty():
        some = _hopeful(unsure, hopes)
        keys = some.groupBy("node").agg(F.collect_set("key").alias("keys"))
        known = keys.join(_texts(plain, some.select("node"), nodes), "node")
        late = staged(_blocks(some, known).mapInArrow(_by_block(_block_links), "a long, b long"), "nd-late")
        if not late.isEmpty():
            # Components so far are stars, so no link is followed again.
            roots = components(roots.toDF("a", "b").unionByName(late))
    by_hash = staged(_named(nodes, roots).withColumn("n", F.col("copies")), "nd-classes")
    discard(pairs, near, checked, unsure)
    hexed = F.lower(F.hex("hash")).alias("text_md5")
    return spread_join(rows.select("doc_id", "hash"), by_hash, "hash", "n").select("doc_id", "class_id", "copies", hexed, "class_md5")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of its least doc_id and the text it names; of equal rows, one."""
    classes = staged(near_duplicates(docs.select("doc_id", "text")), "nd-kept")
    (name,) = free(docs, "_key")
    key = lambda doc_id, md5: F.struct(doc_id.alias("id"), md5.alias("md5")).alias(name)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_md5") == F.col("class_md5"))
    counted = classes.groupBy(key(F.col("doc_id"), F.col("text_md5")), stays.alias("stays")).agg(F.count("*").alias("rows"))
    counted = staged(counted.where("not stays or rows > 1"), "nd-gone")
    gone, repeated = counted.where("not stays").select(name), counted.where("stays").select(name)
    few = counted.count() <= BROADCAST_ROWS
    near = F.broadcast if few else (lambda df: df)
    mine = key(docs["doc_id"], F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    left = docs.join(near(gone), mine == F.col(name), "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(near(repeated), mine == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(near(repeated), mine == F.col(name), "left_anti").unionByName(once)
