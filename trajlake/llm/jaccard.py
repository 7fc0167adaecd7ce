"""Exact n-gram Jaccard join by prefix filters under several global token orders.

Two sets whose similarity reaches the threshold share a token among the first few of each, under any
order that holds for all sets. The first order puts tokens that one document alone holds before all
others (of half of the tokens, whose documents are counted exactly): most sets then have a prefix of
such tokens and are done. All sets joined by shared prefix tokens, directly or through others, form a
bundle; each further order splits the bundles in the same way. What is linked is in one bundle under every
order, so sets are compared only within the intersection of the bundles. The filters name bundles
instead of pairs: a group of thousands of near copies costs one row per set, not one per pair. In a large
table common tokens chain unlike sets to bundles that grow faster than the table. Such a large bundle is
split by an order of its own, which counts all tokens over the bundle's sets alone, again and again while that
helps. Within a bundle links are verified on the whole sets until every pair of sets is either compared or
known to be connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm import units as U
from trajlake.llm.common import (BROADCAST_ROWS, LOWER_VALUES, binary_array, discard, mix, not_broadcast, prefix_hashes, runs,
                                 segment_hashes, spaced, stored, trim, trimmed, word_bounds)
from trajlake.llm.graph import components, forest, thinned
from trajlake.llm.units import NO_ID, UNIT_BYTES

# Orders beyond the first.
MORE_ORDERS = (2, 3)
# Tokens of two blocks of a bundle that a task compares, at most about.
BLOCK_TOKENS = 1_000_000
# Up to so many blocks of a bundle all meet; beyond, only those of like sizes.
FEW_BLOCKS = 3
SALTS = 16

_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each row: (row, 64-bit hash), sorted by row.

    Words are parted by blanks and the control characters 9 to 13; A-Z count as a-z. Fewer than
    ``words`` words make one shingle of all of them, none an empty set.
    """
    text, starts = spaced(data, offsets)
    s, e = word_bounds(text)
    row = np.searchsorted(starts, s, side="right") - 1
    word = mix(segment_hashes(prefix_hashes(text, LOWER_VALUES), s, e) + (e - s).astype(np.uint64))
    n = len(word)
    count = np.bincount(row, minlength=len(starts))
    whole = max(n - words + 1, 0)
    gram = np.zeros(whole, np.uint64)
    for k in range(words):
        gram += word[k:k + whole] * _MULTIPLIERS[k]
    inside = row[:whole] == row[words - 1:] if whole else np.zeros(0, bool)
    rows, grams = [row[:whole][inside]], [mix(gram[inside], 7)]
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        first = np.searchsorted(row, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = count[few] > k
            short[has] += word[first[has] + k] * _MULTIPLIERS[k]
        rows.append(few)
        grams.append(mix(short + count[few].astype(np.uint64), 8))
    row, gram = np.concatenate(rows), np.concatenate(grams)
    key = (row.astype(np.uint64) << np.uint64(48)) | (gram >> np.uint64(16))
    order = np.argsort(key)
    key, row, gram = key[order], row[order], gram[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _signatures(row: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of each set, whatever the order of its tokens."""
    size = np.bincount(row, minlength=n)
    at = np.cumsum(size) - size
    out = []
    for seed in (21, 22):
        total = np.append(np.uint64(0), np.cumsum(mix(gram, seed), dtype=np.uint64))
        out.append((total[at + size] - total[at]).view(np.int64))
    return size, out[0], out[1]


def _counted(gram: np.ndarray) -> np.ndarray:
    """The half of the tokens whose documents are counted."""
    return (mix(gram, 90) & np.uint64(1)) == 0


def _prefix(row: np.ndarray, gram: np.ndarray, size: np.ndarray, order: int, level: np.ndarray | None, percent: int) -> np.ndarray:
    """Places of the tokens of each set's prefix: its first n - ceil(percent n / 100) + 1 under the order.

    Tokens go by their level, if there are any; ties, and orders without levels as a whole, go by a hash of the
    order's own. Tokens with one hash stay in the order of ``gram``.
    """
    rank = mix(gram, 100 + order) >> np.uint64(25)
    if level is not None:
        rank |= level.astype(np.uint64) << np.uint64(39)
    at = np.argsort((row.astype(np.uint64) << np.uint64(48)) | rank, kind="stable")
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    length = size - (percent * size + 99) // 100 + 1
    return at[place < length[row[at]]]


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for first, last in runs(offsets):
        for i in range(first, last, 1 << 15):
            yield i, min(i + (1 << 15), last)


_ROW_NAMES = ["order", "token", "a", "b", "doc_id", "text_hash", "n", "s1", "s2", "tokens"]
_ROW_SCHEMA = "order int, token long, a long, b long, doc_id long, text_hash long, n long, s1 long, s2 long, tokens binary"


class _Joined:
    """Within a task: the least set reached from the sets of each token, and a link to it from every set that reaches it.

    A group of near copies shares many tokens. They all name the same set here, so that the links between tasks
    are one per group and task, however many tokens the group shares.
    """

    def __init__(self) -> None:
        self.tokens, self.sets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(self, tokens: np.ndarray, sets: np.ndarray) -> None:
        self.tokens.append(tokens)
        self.sets.append(sets)

    def rows(self, order: int) -> pa.RecordBatch:
        token, own = np.concatenate(self.tokens), np.concatenate(self.sets)
        at = np.lexsort((own, token))
        token, own = token[at], own[at]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        head = own[np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))]
        tied, least = thinned(own[~new], head[~new])
        named, n, m = own[new], int(new.sum()), len(tied)
        if m:
            at = np.minimum(np.searchsorted(tied, named), m - 1)
            named = np.where(tied[at] == named, least[at], named)
        none = pa.nulls(n + m, pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + m, order, np.int32)),
            pa.array(np.concatenate([token[new], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
            pa.array(np.concatenate([named, tied])),
            pa.array(np.concatenate([np.zeros(n, np.int64), least]), mask=np.arange(n + m) < n),
            none, none, none, none, none, pa.nulls(n + m, pa.binary())], _ROW_NAMES)


def _links(rows: DataFrame) -> DataFrame:
    """Links of sets that share a token: those found within tasks, and of the set each task names to the least of all.

    A token's rows are one per task at most, however many sets hold it.
    """
    # So a window holds few rows, and the rows pass one exchange.
    least = F.min("a").over(Window.partitionBy("order", "token"))
    across = rows.filter(F.col("token").isNotNull()).select("order", "a", least.alias("b")).filter("a <> b")
    return rows.filter(F.col("b").isNotNull()).select("order", "a", "b").unionByName(across.select("order", "a", "b"))


def _prefixes(words: int, percent: int, units: int):
    """Task per unit: a row per document; of those whose first prefix is not all their own (candidates) also
    the set, the prefix tokens under each order, and the links among them."""
    def task(table: pa.Table) -> pa.Table:
        ids, hashes, text, bounds, found = U.unpacked(table)
        known = U.known_names(found)
        joined, out = {order: _Joined() for order in (1, *MORE_ORDERS)}, []
        for first, last in _runs(bounds):
            n = last - first
            row, gram = shingle_sets(text, bounds[first:last + 1], words)
            size, s1, s2 = _signatures(row, gram, n)
            level = np.full(len(gram), 255, np.uint8)  # tokens that are not counted come last
            counted = _counted(gram)
            level[counted] = U.levels_of(U.names(gram[counted], units), known)
            at = _prefix(row, gram, size, 1, level, percent)
            at = at[level[at] > 0]  # a token of one document links nothing
            joined[1].add(gram[at].view(np.int64), s1[row[at]])
            candidate = np.zeros(n, bool)
            candidate[row[at]] = True
            own = candidate[row]
            row, gram, kept = row[own], gram[own], np.where(candidate, size, 0)
            for order in MORE_ORDERS:
                at = _prefix(row, gram, kept, order, None, percent)
                joined[order].add(gram[at].view(np.int64), s1[row[at]])
            none = pa.nulls(n, pa.int64())
            out.append(pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int32()), none, none, none, pa.array(ids[first:last], mask=ids[first:last] == NO_ID),
                pa.array(hashes[first:last]), pa.array(size), pa.array(s1), pa.array(s2),
                binary_array(gram, np.append(0, np.cumsum(kept)) * 8)], _ROW_NAMES))
        out += [joined[order].rows(order) for order in joined]
        trim()
        return pa.Table.from_batches(out)

    return task


def _led_tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the tokens of sets; eight bytes of the bundle lead each set, and its tokens are those of the bundle only."""
    whole = data[bounds[0]:bounds[-1]].view(np.uint64)
    start = (bounds - bounds[0]) // 8
    row = np.repeat(np.arange(len(start) - 1), np.diff(start) - 1)
    own = np.ones(len(whole), bool)
    own[start[:-1]] = False
    return row, mix(whole[own] ^ mix(whole[start[:-1]], 91)[row], 92)


def _rare_prefixes(percent: int, order: int, units: int):
    """Task per unit of sets led by their bundles: links by the prefix tokens that another set of the bundle holds."""
    def task(table: pa.Table) -> pa.Table:
        nodes, _, data, bounds, found = U.unpacked(table)
        known, joined = U.known_names(found), _Joined()
        for first, last in _runs(bounds):
            row, gram = _led_tokens(data, bounds[first:last + 1])
            level = U.levels_of(U.names(gram, units), known)
            at = _prefix(row, gram, np.bincount(row, minlength=last - first), order, level, percent)
            at = at[level[at] > 0]
            joined.add(gram[at].view(np.int64), nodes[first:last][row[at]])
        rows = joined.rows(order)
        trim()
        return pa.Table.from_batches([rows]).select(["order", "token", "a", "b"])

    return task


def _split(labelled: DataFrame, held: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """The sets of ``labelled`` (stored), in finer bundles where a bundle has more than a few blocks; others that link to none go.

    Near sets share a token among the first of each under any order, also one made for their bundle alone. There all
    tokens are counted, and only over the bundle's sets: few unlike sets stay chained. A round that leaves
    more than three quarters of the tokens in large bundles is the last.
    """
    before, order = math.inf, max(MORE_ORDERS)
    while True:
        large = labelled.groupBy("bundle").agg(F.count("*").alias("sets"), F.sum("n").alias("all")).filter(
            (F.col("sets") > 1) & (F.ceil(F.col("all") * 2 / block_tokens) > FEW_BLOCKS))
        tokens = large.agg(F.sum("all")).first()[0] or 0
        if not tokens or tokens > 0.75 * before:
            return labelled
        before, order = tokens, order + 1
        # Few, as each has a fixed number of tokens at least.
        few = F.broadcast(large.select("bundle"))
        inside = labelled.join(few, "bundle")
        units = -(-tokens * 8 // UNIT_BYTES)
        lead = F.unhex(F.lpad(F.hex("bundle"), 16, "0"))
        members = inside.select(F.col("s1").alias("w1"), F.col("s2").alias("w2"), F.col("least").alias("w_least"), "node", "bundle")
        sets = stored(_with_tokens(held, members).select(
            "node", F.lit(0).cast("long").alias("none"), F.pmod(F.xxhash64("node"), F.lit(units)).cast("int").alias("unit"),
            F.concat(lead, "tokens").alias("tokens")), "op5-large")
        both = U.packed_texts(sets).unionByName(U.shared_tags(sets, _led_tokens, units))
        links = stored(both.groupBy("unit").applyInArrow(
            _rare_prefixes(percent, order, units), "order int, token long, a long, b long"), "op5-large")
        labels = components(_links(links).select("a", "b"), "op5-bundles")
        parted = inside.join(labels, "node").withColumn("bundle", F.xxhash64("bundle", "label")).select(labelled.columns)
        after = stored(labelled.join(few, "bundle", "left_anti").select(labelled.columns).unionByName(parted), "op5-labelled")
        for gone in (sets, links, labelled):
            discard(gone)
        labelled = after


def _with_tokens(held: DataFrame, members: DataFrame) -> DataFrame:
    """Members (w1, w2, w_least and others) with the tokens of the row that stands for the set."""
    return held.hint("merge").join(
        members, (F.col("s1") == F.col("w1")) & (F.col("s2") == F.col("w2")) & F.col("own").eqNullSafe(F.col("w_least")))


def link_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Component (smallest place) of each set under links between sets of unlike ``side`` (or all, if one side).

    Every set that is not yet connected to all others is compared with all sets, those of the smallest
    components first. What stays uncompared lies in one component.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(size) - size
    mark = np.zeros(int(token.max()) + 1, np.int32)
    label = np.arange(m)
    both = len(np.unique(side)) > 1
    todo = np.ones(m, bool)
    while True:
        waiting = np.bincount(label[todo], minlength=m)
        open_labels = np.flatnonzero(waiting)
        if len(open_labels) <= 1:
            return label
        x = int(np.flatnonzero(todo & (label == open_labels[np.argmin(waiting[open_labels])]))[0])
        todo[x] = False
        own = token[at[x]:at[x] + size[x]]
        mark[own] = 1
        shared = np.add.reduceat(mark[token], at)
        mark[own] = 0
        near = 100 * shared >= percent * (size + size[x] - shared)
        if both:
            near &= side != side[x]
        near[x] = True
        group = np.unique(label[near])
        if len(group) > 1:
            label[np.isin(label, group)] = group[0]


def _verify(percent: int):
    """Task over (bundle, i, j, node, side, tokens) sorted by the first three: links of each node to the least in its component,
    thinned out over all that the task reads."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            node = np.array([r[1] for r in rows], np.int64)
            order = np.argsort(node)
            label = link_sets([np.frombuffer(rows[k][3], np.uint64) for k in order], np.array([rows[k][2] for k in order]), percent)
            tied = np.flatnonzero(label != np.arange(len(label)))
            return node[order][tied], node[order][label[tied]]

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bundle", "i", "j", "node", "side", "tokens")]
            a, b = [], []
            for key0, i, j, node, side, tokens in zip(*cols):
                key = (key0, i, j)
                if held and held[0][0] != key:
                    x, y = done(held)
                    a.append(x)
                    b.append(y)
                    held = []
                held.append((key, node, side, tokens))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        if held:
            x, y = done(held)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return trimmed(lambda batches: forest(links(batches)))


def size_band(n: Column, percent: int) -> Column:
    """Number of the band of sizes that ``n`` falls into; sets that are near lie in one band or in neighbouring ones."""
    # A little wider than the ratio, so that rounding cannot part sets at its bounds.
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    return F.floor(F.log(n.cast("double")) / F.lit(width)).cast("long")


def _blocked(labelled: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Each set of a bundle of two or more with its block (``side``) and the blocks (``others``) it must meet.

    A bundle of few blocks is cut by a hash of the set, and all blocks meet. A larger one is cut by size band
    and hash: only blocks of neighbouring bands can hold near sets.
    """
    banded = labelled.withColumn("band", size_band(F.col("n"), percent))
    per_band = banded.groupBy("bundle", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    blocks = F.ceil(F.col("all") * 2 / block_tokens).cast("int")
    sizes = per_band.groupBy("bundle").agg(
        F.sum("sets").alias("sets"), F.sum("all").alias("all"), F.collect_list(F.struct("band", blocks.alias("blocks"))).alias("bands"))
    sizes = sizes.filter("sets > 1").select("bundle", blocks.alias("blocks"), F.when(blocks > FEW_BLOCKS, F.col("bands")).alias("bands"))
    # A block's number: its band, or 0, and its place among the band's blocks.
    numbered = lambda band, i: band * F.lit(1 << 24) + i
    dealt = lambda n: F.pmod(F.xxhash64("node"), n)
    mine = F.array_max(F.filter("bands", lambda x: x["band"] == F.col("band")))["blocks"]
    near = F.filter("bands", lambda x: F.abs(x["band"] - F.col("band")) <= 1)
    whole = F.col("bands").isNull()
    others = F.when(whole, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i.cast("long"))).otherwise(
        F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda i: numbered(x["band"], i)))))
    return banded.join(sizes, "bundle").select(
        F.col("s1").alias("w1"), F.col("s2").alias("w2"), F.col("least").alias("w_least"), "node", "bundle",
        F.when(whole, dealt(F.col("blocks"))).otherwise(numbered(F.col("band"), dealt(mine))).alias("side"), others.alias("others"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Connected components of documents whose shingle sets have a Jaccard similarity of percent/100 or more.

    One row per document: doc_id, n_shingles, component_id (smallest doc_id in its component), text_hash,
    and keep, true for the row with the smallest (doc_id, text_hash) of a component, null ids last.

    Null or blank text: an empty set, linked with nothing, its own component. Rows with one set are linked
    whatever their ids; a null id never names a component unless all ids in it are null. Rows equal in id
    and text are kept together. An empty table gives no rows. Other columns are ignored. Tokens are
    64-bit hashes; sets are told apart by 128 bits.
    """
    dealt, units = U.dealt(docs, id_col, text_col, UNIT_BYTES)

    def tags(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
        for first, last in _runs(bounds):
            row, gram = shingle_sets(data, bounds[first:last + 1], words)
            counted = _counted(gram)
            found.append((first + row[counted], gram[counted]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    # Stored, so that the files of the tags' exchange are gone before the texts are moved.
    answers = stored(U.shared_tags(dealt, tags, units), "op5-answers")
    both = U.packed_texts(dealt).unionByName(answers)
    surveyed = stored(both.groupBy("unit").applyInArrow(_prefixes(words, percent, units), _ROW_SCHEMA), "op5-sets")
    discard(answers)
    rows = surveyed.filter(F.col("order").isNull()).select("doc_id", "text_hash", "n", "s1", "s2")
    # One row stands for all with the same set.
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = stored(rows.filter("n > 0").groupBy("s1", "s2").agg(
        F.min(least).alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "op5-classes")
    # The orders' graphs side by side: the lowest bits of a node tell the order, the others the set.
    trio = lambda c: (F.col(c).bitwiseAND(F.lit(~3)) + F.col("order")).alias(c)
    joined = _links(surveyed.filter(F.col("order").isNotNull()).select("order", "token", "a", "b"))
    labels = components(joined.select(trio("a"), trio("b")), "op5-bundles")
    by_set = labels.groupBy(F.col("node").bitwiseAND(F.lit(~3)).alias("s")).agg(
        *[F.max(F.when(F.col("node").bitwiseAND(F.lit(3)) == o, F.col("label"))).alias(f"label_{o}") for o in (1, *MORE_ORDERS)])
    bundled = by_set.dropna().select("s", F.xxhash64(*[f"label_{o}" for o in (1, *MORE_ORDERS)]).alias("bundle"))
    labelled = stored(sets.join(bundled, F.col("s1").bitwiseAND(F.lit(~3)) == F.col("s")).select(
        "s1", "s2", "n", "least", "node", "bundle"), "op5-labelled")
    held = surveyed.filter(F.octet_length("tokens") > 0).select("s1", "s2", least.alias("own"), "tokens")
    labelled = _split(labelled, held, percent, block_tokens)
    # The sets themselves join last, and once.
    tasks = _with_tokens(held, _blocked(labelled, percent, block_tokens)).withColumn("other", F.explode("others")).select(
        "bundle", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", "tokens")
    links = tasks.repartition("bundle", "i", "j").sortWithinPartitions("bundle", "i", "j").mapInArrow(_verify(percent), "a long, b long")
    final = components(links, "op5-links", thin=False)
    in_component = labelled.join(final, "node").select("s1", "s2", "label")
    merged = sets.join(in_component, ["s1", "s2"], "left")
    linked = merged.filter(F.col("label").isNotNull())
    best = linked.groupBy("label").agg(F.min("least").alias("best"))
    classes = linked.join(best, "label").select("s1", "s2", "best").unionByName(
        merged.filter(F.col("label").isNull() & (F.col("copies") > 1)).select("s1", "s2", F.col("least").alias("best")))
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    out = not_broadcast(out, sets.count() * SALTS).join(
        salted, ["s1", "s2", "salt"], "left").withColumn("own", least)
    out = out.withColumn("best", F.when((F.col("n") > 0) & F.col("best").isNotNull(), F.col("best")).otherwise(F.col("own")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), "text_hash",
                      F.col("best").eqNullSafe(F.col("own")).alias("keep"))
