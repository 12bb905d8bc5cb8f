"""MinHash near-duplicate detection by bottom-k sketches from one hash function.

1. Every document's set of five-word shingles is hashed once; the K smallest
   values are its sketch, the whole set if it has no more.  Documents of one word
   sequence form a class and go on as one, under a number of the class's own.
2. Inverted lists: a sketch of m values of which a partner must share at least c
   has its partner in the list of one of its m - c + 1 rarest values.  For sets of
   at most EXACT shingles c follows from the threshold and holds always; for larger
   ones two sketches of documents at the threshold share at least LEAST of K values
   but for a chance of 2e-9.  The rarest values are taken, so a line or passage that
   many documents share makes no long lists unless they consist of little else.
3. A list's members are compared with its hub first, the member whose values most other
   sketches have (in a group of copies the original, or one close to it), then
   with others, drawn anew in each round; of its lists' hubs a document meets the one it shares most lists with.
   Links form components: a group of n copies costs n comparisons a round.  Rounds go on while
   one in LINKED of a round's comparisons is a new link.
   The union sketch of a pair (the K smallest of both) estimates its similarity and
   drops pairs that are far off.
4. Lists that still hold several components are finished on full sets, see below.  Within their
   documents each has c shingles that others have too; two sets of n and n' at the
   threshold share at least 3/7 (n + n'), so both must have c that large and meet in one
   of the c - 3/4 n + 1 rarest shingles of each; and at the first one they share, both must
   still have that many to come.  Most documents drop out by c alone.  A document that would still meet more than
   MOST_ROWS others outside the largest component of a list is heavy: heavy documents are broadcast in blocks and
   looked for in all members, which gives a row for each document and other component that it is linked with, and what is left gives
   at most MOST_ROWS rows a document, however large a group of texts just below the threshold is.
   With ``exact`` this search is made over all documents, and no chance is left to sketches.
5. Every candidate is verified on the words: 100 * shared >= 75 * union.

Nothing is capped: every list is finished.  Links that are not compared lie within
a component already found, so components are those of all links.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than five are one shingle.
Defined cases: documents without words, or with null text, are linked with nothing;
rows are told apart by their texts, so a doc_id with several texts is several nodes, and rows
without a doc_id take part; component_id is the smallest doc_id in the component, null where
it has none; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernel
from factloom.llm.common import bitmap, components, in_bitmap, join_by_key, release, settle, texts

SHINGLE, PERCENT = 5, 75
#: Most candidate rows of a document in joins; shingles of heavy documents in a block.
MOST_ROWS, BLOCK_SHINGLES = 512, 500_000
#: Sketch length; most shingles for which the bound is certain; least shared values otherwise.
K, EXACT, LEAST = 64, 48, 24
#: Fewest and most rounds of hubs; comparisons for each link that a round must find for another one.
HUB_ROUNDS, MOST_HUB_ROUNDS, LINKED = 2, 6, 20
#: Most rows to remove whose two hashes are broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000
_SIGN = np.uint64(1 << 63)


def _key(raw: bytes) -> bytes:
    """Tells word sequences apart; ``raw`` is lower-cased."""
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the text, number of shingles, key of the word sequence and sketch.  Hash values
    are shifted to signed longs in the same order."""
    for batch in batches:
        count, key, sketch = [], [], []
        for w in textkernel.words(batch.column("text"), lower=True):
            for i, h in enumerate(textkernel.document_shingles(w, w.hashes(), SHINGLE)):
                count.append(len(h))
                sketch.append((h[:K] ^ _SIGN).view(np.int64))
                key.append(_key(w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()))
        bounds = np.cumsum([0, *map(len, sketch)], dtype=np.int32)
        values = pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), values)], names=[*names, "n_shingles", "key", "sketch"])


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the keys of their word sequences, each sequence once for a task."""
    seen: set[bytes] = set()
    for batch in batches:
        found = [_key(t.as_py().encode().lower()) for t in batch.column(0)]
        new = []
        for i, k in enumerate(found):
            if k not in seen:
                seen.add(k)
                new.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in new], pa.binary()), batch.column(0).take(pa.array(new, pa.int64()))], names=["key", "text"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose union sketch does not rule them out."""
    for batch in batches:
        sa, sb = batch.column("sa"), batch.column("sb")
        keep = []
        for x, y in zip(sa, sb, strict=True):
            x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            both = np.concatenate([x, y])
            both.sort()
            same = both[1:] == both[:-1]
            union = len(both) - int(same.sum())
            if len(x) < K and len(y) < K:
                keep.append(100 * int(same.sum()) >= PERCENT * union)
            else:
                limit = np.partition(np.unique(both), K - 1)[K - 1] if union > K else both[-1]
                keep.append(int((same & (both[1:] <= limit)).sum()) >= LEAST)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, own = [], None, set()
        for a, ta, tb in zip(batch.column("a"), batch.column("ta"), batch.column("tb"), strict=True):
            if a.as_py() != last:
                last, own = a.as_py(), textkernel.shingle_set(ta.as_py(), SHINGLE)
            other = textkernel.shingle_set(tb.as_py(), SHINGLE)
            shared = len(own & other)
            keep.append(100 * shared >= PERCENT * (len(own) + len(other) - shared) > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _common(bits):
    """The sketch values that other sketches may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketch")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            keep = in_bitmap(bits.value, values.view(np.uint64))
            row = np.repeat(np.arange(len(lists)), size)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), batch.column("rep").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(size[row].astype(np.int32))], names=["value", "rep", "n", "m"])

    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        for w in textkernel.words(batch.column("text"), lower=True):
            for i, h in enumerate(textkernel.document_shingles(w, w.hashes(), SHINGLE)):
                yield pa.RecordBatch.from_arrays([pa.array((h ^ _SIGN).view(np.int64)), pa.array(np.full(len(h), ids[w.first + i])), pa.array(np.full(len(h), len(h)))], names=["value", "rep", "n"])


def _texts_of(reps: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, text): a text of each of the classes, settled.  Documents are picked by a doc_id of the class, then by their words."""
    wanted = settle(classes.select("rep", "key", "doc").join(reps.select("rep"), "rep", "left_semi"), "wanted")
    near = docs.join(wanted.select("doc").distinct(), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("text")
    return settle(near.mapInArrow(_first_texts, "key binary, text string").join(wanted.select("key", "rep"), "key").select("rep", "text"), "texts")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, sketches: DataFrame | None = None, text: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of representatives that are links, settled; estimated first where sketches are given."""
    likely = pairs
    if sketches is not None:
        likely = settle(pairs.join(sketches.toDF("b", "sb"), "b").join(sketches.toDF("a", "sa"), "a").select("a", "b", "sa", "sb").mapInArrow(_estimate, "a long, b long"), "likely")
    if text is None:
        text = _texts_of(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), docs, classes)
    found = likely.join(text.toDF("b", "tb"), "b").join(text.toDF("a", "ta"), "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")
    return settle(found.distinct(), "links")


def _near(n: str, other: str):
    """Set sizes that the threshold allows."""
    return (F.col(n) * PERCENT <= F.col(other) * 100) & (F.col(other) * PERCENT <= F.col(n) * 100)


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rarest(rows: DataFrame, take, *keys: str) -> DataFrame:
    """Of the rows (value, *keys) the rarest of each key: values in two rows or more, as many as ``take``,
    a number over ``common``, says.  Adds ``common``, the number of such values, ``fame``, how much others have them,
    and ``place``, from 0, the rarest first."""
    lengths = settle(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "lengths")
    listed = rows.join(lengths, "value").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("c"), F.sum(F.log2("df")).alias("fame"))
    listed = listed.withColumn("common", F.size("c")).withColumn("take", F.greatest(take, F.lit(0)).cast("int")).where("take > 0")
    return listed.select(*keys, "common", "fame", F.posexplode(F.slice("c", F.lit(1), F.col("take"))).alias("place", "c")).select(F.col("c.value").alias("value"), *keys, "common", "fame", "place")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, rep, n, common, fame): each sketch under the rarest values that it must share one of with a partner."""
    values = classes.select(F.explode("sketch").alias("value"))
    bits = classes.sparkSession.sparkContext.broadcast(bitmap(settle(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select("value"), "shared"), "value"))
    common = classes.select("rep", F.col("n_shingles").alias("n"), "sketch").mapInArrow(_common(bits), "value long, rep long, n long, m int")
    share = F.when(F.col("n") <= EXACT, F.ceil(F.col("m") * PERCENT / 100)).otherwise(LEAST)
    return _rarest(common, F.col("common") - share + 1, "rep", "n", "m").drop("m", "place")  # values in one sketch alone are rarer still: they use up the rest


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with the members' components."""
    lists = settle(lists.drop("component").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "lists")
    several = lists.groupBy("value").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("value")
    return settle(lists.join(settle(several, "open"), "value"), "lists")


def _heavy(rare: DataFrame) -> DataFrame:
    """(rep) that stand beside more than MOST_ROWS members of other components in lists whose largest component is not their own."""
    whole = rare.groupBy("value").agg(F.count("*").alias("all"), F.max(F.struct("members", "component")).alias("top")).select("value", "all", F.col("top.component").alias("largest"))
    own = rare.groupBy("value", "component").agg(F.count("*").alias("own")).join(whole, "value").where("component <> largest").select("value", "component", (F.col("all") - F.col("own")).alias("others"))
    met = rare.select("value", "component", "rep").join(own, ["value", "component"]).groupBy("rep").agg(F.sum("others").alias("rows"))
    return settle(met.where(F.col("rows") > MOST_ROWS).select("rep"), "heavy")


def _heavy_links(heavy: DataFrame, text: DataFrame) -> DataFrame | None:
    """Pairs (a, b) at the threshold, by hashes, of a heavy document and one of another component, for each document of ``text``
    (rep, text, component) at most one with each other component; None without heavy ones."""
    context = text.sparkSession.sparkContext
    texts_ = settle(text.join(heavy, "rep", "left_semi"), "heavy_texts")
    size = texts_.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0]
    if size is None:
        return None
    blocks = -(-size // BLOCK_SHINGLES)
    found = None
    for b in range(blocks):
        part = texts_.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == b).toArrow()
        sets = [h for w in textkernel.words(part.column("text").combine_chunks(), lower=True) for h in textkernel.document_shingles(w, w.hashes(), SHINGLE)] if part.num_rows else []
        if not sets:
            continue
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        order = np.argsort(value, kind="stable")
        values, at = np.unique(value[order], return_index=True)
        shared = context.broadcast((values, np.append(at, len(value)), owner[order], np.array([len(h) for h in sets]), part.column("rep").to_numpy(), part.column("component").to_numpy()))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            values, bounds, owners, sizes, reps, groups = shared.value
            for batch in batches:
                ids, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component"))
                a, z = [], []
                for w in textkernel.words(batch.column("text"), lower=True):
                    for i, h in enumerate(textkernel.document_shingles(w, w.hashes(), SHINGLE)):
                        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                        at = at[values[at] == h]
                        if not len(at):
                            continue
                        many = bounds[at + 1] - bounds[at]
                        hit = owners[np.repeat(bounds[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                        both = np.bincount(hit, minlength=len(sizes))
                        near = np.flatnonzero((100 * both >= PERCENT * (len(h) + sizes - both)) & (groups != own[w.first + i]))
                        near = near[np.unique(groups[near], return_index=True)[1]]  # components that are linked once are one
                        a += np.minimum(reps[near], ids[w.first + i]).tolist()
                        z += np.maximum(reps[near], ids[w.first + i]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

        one = settle(text.mapInArrow(search, "a long, b long"), "heavy_links")
        shared.destroy()
        found = one if found is None else found.union(one)
    return found


def _full_links(lists: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The links (a, b) between different components in the open lists, on full sets of shingles."""
    members = settle(lists.select("rep", "component").distinct(), "members")
    members = settle(members.join(members.groupBy("component").agg(F.count("*").alias("members")), "component"), "members")
    text = _texts_of(members, docs, classes)
    full = settle(text.mapInArrow(_all_shingles, "value long, rep long, n long"), "full")
    least = F.ceil(F.col("n") * PERCENT / 100)
    rare = settle(_rarest(full, F.col("common") - least + 1, "rep", "n").drop("fame").join(members, "rep"), "rare")
    heavy = _heavy(rare)
    rare = rare.join(heavy, "rep", "left_anti")
    other = rare.select("value", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "common", "component", "place")))
    enough = F.least(F.col("common") - F.col("place"), F.col("common2") - F.col("place2")) * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("n2"))
    pairs = rare.join(other, "value").where((F.col("rep") < F.col("rep2")) & (F.col("component") != F.col("component2")) & _near("n", "n2") & enough).select(*_ordered("rep", "rep2")).distinct()
    more = _heavy_links(heavy, text.join(members.select("rep", "component"), "rep"))
    pairs = pairs if more is None else pairs.union(more.distinct())
    return _links(settle(pairs, "pairs"), docs, classes, text=text)


def _grouped(docs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` has doc_id, text and more.  Returns its rows without the text, with n_shingles, rep (the class; null
    without words) and doc (the class's smallest doc_id); the classes; and the component of every class with a link."""
    more = "".join(f"{c} {t}, " for c, t in docs.dtypes if c != "text")
    rows = settle(docs.mapInArrow(_sketches, f"{more}n_shingles long, key binary, sketch array<long>"), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    members = settle(join_by_key(rows.drop("sketch"), classes.select("key", "rep", "doc", "members"), "key", "members", rows.count()).drop("key"), "members")
    lists = settle(inverted_lists(classes).withColumn("component", F.col("rep")), "lists")
    sketches = classes.select("rep", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")))
    links, turn, more = None, 0, True
    while turn < HUB_ROUNDS or more and turn < MOST_HUB_ROUNDS:
        first = F.xxhash64(F.col("rep"), F.lit(turn)) if turn else -F.col("fame")
        hub = F.min(F.struct(first, F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component")))
        hubs = settle(lists.groupBy("value").agg(hub.alias("h")).select("value", "h.hub", "h.hub_n", "h.hub_component"), "hubs")
        met = lists.join(hubs, "value").where((F.col("component") != F.col("hub_component")) & _near("n", "hub_n")).groupBy("rep", "hub").agg(F.count("*").alias("lists"))
        pairs = met.groupBy("rep").agg(F.max_by("hub", F.struct("lists", -F.col("hub"))).alias("hub")).select(*_ordered("rep", "hub")).distinct()
        pairs = settle(pairs, "pairs")
        found = _links(pairs, docs, classes, sketches)
        release(docs.sparkSession)  # the driver's heap shrinks, too: a turn has dozens of plans
        links = found if links is None else links.union(found)
        labels = components(links)
        lists = _open_lists(lists, labels)
        release(docs.sparkSession)
        turn, more = turn + 1, found.count() * LINKED >= pairs.count() > 0
    if exact:  # all classes, not only those in lists that a sketch's values still leave open
        lists = classes.select("rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found = _full_links(lists, docs, classes)
    if found.limit(1).count():
        labels = components(links.union(found))
    return members, classes, labels.withColumnRenamed("node", "rep")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, or its own) and kept.
    ``exact``: sketches find most links, but the full sets of all documents are searched for the rest, so none is left to chance."""
    members, classes, labels = _grouped(texts(documents, id_col, text_col), exact)
    least = labels.join(classes.select("rep", "doc"), "rep").groupBy("component").agg(F.min("doc").alias("least"))
    linked = settle(labels.join(least, "component").select("rep", "least", F.lit(True).alias("linked")), "linked")
    out = members.join(linked, "rep", "left")
    component_id = F.when(F.col("linked"), F.col("least")).when(F.col("rep").isNotNull(), F.col("doc")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _whole_row(documents: DataFrame) -> list:
    """Two hashes of a row's columns, 128 bits: equal rows have equal ones.  Maps and variants are left out."""
    named = [F.col(f"`{f.name}`") for f in documents.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return [F.xxhash64(F.lit(seed), *named).alias(f"__row_{seed}") for seed in (1, 2)]


def remove_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents with one row of each component left, all columns kept: the one with the smallest doc_id (null
    last), ties by a hash of the row; of equal rows one.  Rows without words all stay.  Rows that go are found by hashes
    of themselves; up to BROADCAST_ROWS of them are broadcast, so that texts stay where they lie."""
    row = ["__row_1", "__row_2"]
    keyed = documents.select("*", *_whole_row(documents))
    members, _, labels = _grouped(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row))
    grouped = members.where("rep IS NOT NULL").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *row)).alias("f")).select(*(F.col(f"f.{c}") for c in row), F.lit(True).alias("first"))
    rows = grouped.groupBy(*row).agg(F.count("*").alias("n")).join(first, row, "left")
    rows = settle(rows.where("first IS NULL OR n > 1").select(*row, (F.col("first").isNotNull()).alias("twin")), "repeated")
    small = rows.count() <= BROADCAST_ROWS
    repeated = F.broadcast(rows) if small else rows
    left = keyed.join(repeated.select(*row), row, "left_anti")
    if rows.where("twin").limit(1).count():
        twins = keyed.join(repeated.where("twin").select(*row), row, "left_semi")
        left = left.unionByName(twins.dropDuplicates(row))
    return left.drop(*row)
