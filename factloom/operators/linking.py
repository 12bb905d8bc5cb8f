"""Terms of facts to ontology concepts: exact and synonym by join, fuzzy for what is left.

The distinct surfaces of all slots are linked once, settled, and joined back to the facts
slot by slot, however often they occur; lists of side effects are joined as lists.  These tables are
small beside the facts and mostly broadcast, so facts stay where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions.similarity import letter_bits, most_shared
from factloom.functions.text import listed, surface, text
from factloom.plans.indexing import ranked
from factloom.plans.workspace import settle

SLOTS = {"drug": ("drugs", "drug_name"), "condition": ("conditions", "condition_name"), "relation": ("relations", "relation"), "outcome": ("outcomes", "outcome")}
FUZZY_CUTOFF = 0.86
#: Most keys of an ontology that are broadcast; beyond it the joins shuffle.
BROADCAST_KEYS = 500_000


def concept_keys(concepts: DataFrame) -> DataFrame:
    """(entity_type, key, concept_id, label, provider, match_type, score): a label's key goes to the last concept
    with that label, before any synonym; a synonym's to the first concept that has it."""
    label = concepts.select("entity_type", "concept_seq", F.lit(0).alias("pos"), F.lit("exact").alias("match_type"), surface("label").alias("key"), "concept_id", "label", "provider")
    synonym = concepts.select("entity_type", "concept_seq", F.posexplode("synonyms").alias("pos", "s"), "concept_id", "label", "provider")
    synonym = synonym.select("entity_type", "concept_seq", "pos", F.lit("synonym").alias("match_type"), surface("s").alias("key"), "concept_id", "label", "provider")
    rank = F.row_number().over(Window.partitionBy("entity_type", "key").orderBy((F.col("match_type") != "exact").cast("int"), F.when(F.col("match_type") == "exact", -F.col("concept_seq")).otherwise(F.col("concept_seq")), "pos"))
    keys = label.unionByName(synonym).where("key <> ''").withColumn("r", rank).where("r = 1")
    return keys.select("entity_type", "key", "concept_id", "label", "provider", "match_type", F.lit(1.0).alias("score"))


def _checked(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def slots(facts: DataFrame, key: str = "fact_index") -> DataFrame:
    """(key, slot, pos, entity_type, text): every term of a fact that is looked up."""
    single = [F.struct(F.lit(s).alias("slot"), F.lit(0).alias("pos"), F.lit(e).alias("entity_type"), text(c).alias("text")) for s, (e, c) in SLOTS.items()]
    several = F.transform(listed("side_effects"), lambda x, i: F.struct(F.lit("side_effect").alias("slot"), i.alias("pos"), F.lit("side_effects").alias("entity_type"), x.alias("text")))
    long = facts.select(key, F.explode(F.concat(F.array(*single), several)).alias("s")).select(key, "s.*")
    return long.where("slot <> 'outcome' OR text <> ''")


def link_exact(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """(entity_type, text) with the matched concept, or match_type unmatched and score 0."""
    found = terms.withColumn("key", surface("text")).join(_checked(keys), ["entity_type", "key"], "left")
    return found.withColumn("match_type", F.coalesce("match_type", F.lit("unmatched"))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def _tolerance(la: Column, lb: Column, cutoff: float) -> tuple[Column, Column, Column]:
    """Of two texts at the cutoff: characters of each that may have no partner, and of both together.  A ratio of
    c leaves 2 m >= c (a + b) characters in matching blocks, which lie in the same order in both."""
    matched = F.ceil(cutoff / 2 * (la + lb) - 1e-9).cast("int")
    return la - matched, lb - matched, la + lb - 2 * matched


def _partners(length: Column, cutoff: float) -> Column:
    """The lengths that a text at the cutoff may have."""
    reach = (2 - cutoff) / cutoff
    return F.sequence(F.ceil(length / reach - 1e-9).cast("int"), F.floor(length * reach + 1e-9).cast("int"))


def _segment(i: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Start and size of the i-th of ``edits`` + 1 near equal segments."""
    start = F.floor(i * length / (edits + 1)).cast("int")
    return start, F.floor((i + 1) * length / (edits + 1)).cast("int") - start


def _with_letters(rows: DataFrame, text_col: str, prefix: str) -> DataFrame:
    return rows.withColumns(dict(zip([f"{prefix}{i}" for i in range(3)], letter_bits(F.col(text_col)), strict=True)))


#: Most texts that a pair of lengths may make of one of its two texts by leaving characters out; beyond it segments are compared.
MOST_SHORTENED = 500


def _by_shortened(more: Column, fewer: Column, la: Column, lb: Column) -> Column:
    """Whether texts of two lengths are found by leaving out the characters that may have no partner."""
    ways = lambda n, k: F.when(k <= 0, 1).when(k == 1, n).when(k == 2, n * (n - 1) / 2).when(k == 3, n * (n - 1) * (n - 2) / 6).otherwise(MOST_SHORTENED + 1)
    return (ways(la, more) <= MOST_SHORTENED) & (ways(lb, fewer) <= MOST_SHORTENED)


def _shortened(x: str, out: Column) -> Column:
    """All texts with 0 to 3 characters less."""

    def less(texts: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(texts, lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1))))))

    none = F.array(F.col(x))
    return F.when(out <= 0, none).when(out == 1, less(none)).when(out == 2, less(less(none))).otherwise(less(less(less(none))))


def shortened(rows: DataFrame, text_col: str, cutoff: float, known: bool) -> DataFrame:
    """(entity_type, place, text_col): for each length of a partner what is left of a text without the characters that may have
    none, as a hash.  Two texts at the cutoff have one of them in common, and hardly any others do."""
    n = F.length(text_col)
    sized = rows.select("entity_type", text_col, F.explode(_partners(n, cutoff)).alias("other"))
    own, size = (F.col("other"), n) if known else (n, F.col("other"))
    more, fewer, _ = _tolerance(own, size, cutoff)
    sized = sized.select("*", own.alias("own"), size.alias("size"), more.alias("more"), fewer.alias("fewer"))
    sized = sized.where(_by_shortened(F.col("more"), F.col("fewer"), F.col("own"), F.col("size")))
    left = sized.select("entity_type", text_col, "own", "size", F.explode_outer(_shortened(text_col, F.col("fewer" if known else "more"))).alias("left"))
    return left.select("entity_type", F.xxhash64("own", "size", "left").alias("place"), text_col)


def segment_index(keys: DataFrame, cutoff: float) -> DataFrame:
    """(entity_type, size, edits, segment, piece, known, k0, k1, k2): each key cut into one segment more than it may have edits.  Every
    character without a partner spoils one segment at most, so one of them stands whole in any text at the cutoff."""
    size = F.length("known")
    sized = keys.select("entity_type", "known", size.alias("size"), F.explode(_partners(size, cutoff)).alias("own"))
    more, fewer, edits = _tolerance(F.col("own"), F.col("size"), cutoff)
    sized = sized.where(~_by_shortened(more, fewer, F.col("own"), F.col("size"))).select("entity_type", "known", "size", edits.alias("edits")).distinct()
    cut = _with_letters(sized, "known", "k").select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("segment"))
    start, long = _segment(F.col("segment"), F.col("size"), F.col("edits"))
    return cut.select("entity_type", "size", "edits", "segment", F.substr("known", start + 1, long).alias("piece"), "known", "k0", "k1", "k2")


def segment_probes(terms: DataFrame, cutoff: float) -> DataFrame:
    """(entity_type, size, edits, segment, piece, key, own, t0, t1, t2): what the segments of keys of any fitting size look like in a
    term, at the places to which characters without a partner can have moved them."""
    own = F.length("key")
    sized = terms.select("entity_type", "key", own.alias("own"), F.explode(_partners(own, cutoff)).alias("size"))
    more, fewer, edits = _tolerance(F.col("own"), F.col("size"), cutoff)
    sized = sized.where(~_by_shortened(more, fewer, F.col("own"), F.col("size"))).withColumns({"more": more, "fewer": fewer, "edits": edits})
    each = _with_letters(sized, "key", "t").select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("segment"))
    start, long = _segment(F.col("segment"), F.col("size"), F.col("edits"))
    first, last = F.greatest(start - F.col("fewer"), F.lit(0)), F.least(start + F.col("more"), F.col("own") - long)
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    pieces = F.array_distinct(F.transform(places, lambda at: F.substr("key", at + 1, long)))
    return each.select("entity_type", "size", "edits", "segment", F.explode(pieces).alias("piece"), "key", "own", "t0", "t1", "t2")


def fuzzy_candidates(misses: DataFrame, keys: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """(entity_type, key, known): the distinct pairs that may reach the cutoff.  Short texts meet at what both have left without
    the characters that may have no partner, long ones at a segment that both have, so no term is compared with all keys; of the long
    ones an upper bound by letters and the edit distance drop most of what met, inside the join."""
    # A small table makes hundreds of times its rows here: it must not be broadcast for its size, nor be one task's work.
    parts = int(misses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    misses, keys = misses.repartition(parts, "key"), keys.repartition(parts, "known")
    near = shortened(misses, "key", cutoff, False).join(shortened(keys, "known", cutoff, True).hint("merge"), ["entity_type", "place"]).select("entity_type", "key", "known")
    met = segment_probes(misses, cutoff).join(segment_index(keys, cutoff).hint("merge"), ["entity_type", "size", "edits", "segment", "piece"])
    shared = most_shared(tuple(F.col(f"t{i}") for i in range(3)), tuple(F.col(f"k{i}") for i in range(3)))
    far = met.where((2.0 * shared >= cutoff * (F.col("own") + F.col("size")) - 1e-9) & (F.levenshtein("key", "known") <= F.col("edits")))
    return near.unionByName(far.select("entity_type", "key", "known")).distinct()


def _most_alike(cutoff: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows by term, those that can be most alike first and of these the largest first: the best key of each term.  What
    cannot beat the best so far is not compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best, found = None, None, []
        for frame in frames:
            for term in zip(frame["entity_type"], frame["key"], frame["known"], frame["bound"], strict=True):
                if term[:2] != at:
                    at, best, alike = term[:2], None, SequenceMatcher(None, "", term[1])
                    found.append([*at, None, None])
                if term[3] < cutoff or best is not None and (term[3], term[2]) <= best:
                    continue
                alike.set_seq1(term[2])
                ratio = alike.ratio()
                if ratio >= cutoff and (best is None or (ratio, term[2]) > best):
                    best = ratio, term[2]
                    found[-1] = [*at, term[2], ratio]
            told = [r for r in found[:-1] if r[2] is not None]
            found = found[-1:]
            yield pd.DataFrame([(e, k, o, SequenceMatcher(None, k, o).ratio()) for e, k, o, _ in told], columns=["entity_type", "key", "known", "score"])
        told = [r for r in found if r[2] is not None]
        yield pd.DataFrame([(e, k, o, SequenceMatcher(None, k, o).ratio()) for e, k, o, _ in told], columns=["entity_type", "key", "known", "score"])

    return run


def link_fuzzy(misses: DataFrame, keys: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """(entity_type, key) of misses -> the most similar known key at or above the cutoff, ties to the largest key.  The ratio has the
    known key as first sequence where it decides, and the term first where it is reported: the measure is not symmetric."""
    distinct = misses.select("entity_type", "key").where("key <> ''").distinct()
    pairs = fuzzy_candidates(distinct, keys.select("entity_type", F.col("key").alias("known")), cutoff)
    la, lb = F.length("key"), F.length("known")
    most = F.when((la == lb) & (F.col("key") != F.col("known")), la - 1).otherwise(F.least(la, lb))
    # Few bytes, but much work: adaptive execution would give them all to one task.
    pairs = pairs.withColumn("bound", 2.0 * most / (la + lb)).repartition(int(misses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_type", "key")
    found = pairs.sortWithinPartitions("entity_type", "key", F.desc("bound"), F.desc("known")).mapInPandas(_most_alike(cutoff), "entity_type string, key string, known string, score double")
    named = keys.select("entity_type", F.col("key").alias("known"), "concept_id", "label", "provider")
    return found.join(named, ["entity_type", "known"]).select("entity_type", "key", "known", "concept_id", "label", "provider", F.lit("fuzzy").alias("match_type"), "score")


def link(terms: DataFrame, keys: DataFrame, fuzzy: bool = True, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Distinct (entity_type, text) -> match columns."""
    exact = settle(link_exact(terms.select("entity_type", "text").distinct(), keys), "surfaces")
    if not fuzzy:
        return exact.drop("key")
    near = link_fuzzy(exact.where("match_type = 'unmatched'"), keys, cutoff).drop("known")
    near = near.select("entity_type", "key", *(F.col(c).alias(f"f_{c}") for c in ("concept_id", "label", "provider", "match_type", "score")))
    both = exact.join(near, ["entity_type", "key"], "left")
    pick = lambda c: F.when(F.col("match_type") != "unmatched", F.col(c)).otherwise(F.coalesce(F.col(f"f_{c}"), F.col(c))).alias(c)
    return both.select("entity_type", "text", *(pick(c) for c in ("concept_id", "label", "provider", "match_type", "score")))


def linked_slots(facts: DataFrame, keys: DataFrame, key: str = "fact_index", fuzzy: bool = True, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """The long form with its matches.  The join back is on the distinct surfaces, a small side
    that adaptive execution broadcasts; a hot surface is split where it is not."""
    long = slots(facts, key)
    return long.join(link(long, keys, fuzzy, cutoff), ["entity_type", "text"])


def match_struct() -> Column:
    return F.struct(*(F.col(c) for c in schemas.MATCH.names))


def normalise(facts: DataFrame, keys: DataFrame, key: str = "fact_index", fuzzy: bool = True, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Facts with ``drug``, ``condition``, ``relation_match``, ``outcome_match`` and ``side_effect_matches``."""
    links = settle(link(slots(facts, key), keys, fuzzy, cutoff).select("entity_type", "text", match_struct().alias("match")), "links")
    out = facts
    for slot, (entity_type, column) in SLOTS.items():
        name = {"drug": "drug", "condition": "condition"}.get(slot, f"{slot}_match")
        known = links.where(F.col("entity_type") == entity_type).select(F.col("text").alias("_text"), F.col("match").alias(name))
        out = out.join(known.where("_text <> ''") if slot == "outcome" else known, text(out[column]) == F.col("_text"), "left").drop("_text")
    lists = facts.select(listed("side_effects").alias("_list")).distinct()
    each = lists.select("_list", F.posexplode("_list").alias("pos", "text")).join(links.where("entity_type = 'side_effects'"), "text")
    matched = each.groupBy("_list").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "match"))), lambda x: x["match"]).alias("side_effect_matches"))
    out = out.withColumn("_listed", listed("side_effects")).join(settle(matched, "lists"), F.col("_listed") == F.col("_list"), "left").drop("_listed", "_list")
    return out.withColumn("side_effect_matches", F.coalesce("side_effect_matches", F.array().cast(T.ArrayType(schemas.MATCH))))


def is_matched(match: Column) -> Column:
    return F.coalesce((match["match_type"] != "unmatched") & match["concept_id"].isNotNull(), F.lit(False))


def match_summary(normalised: DataFrame) -> DataFrame:
    """(slot, matched, unmatched, total).  A missing outcome and an empty list of side effects count as matched."""
    ok = {
        "drug": is_matched(F.col("drug")),
        "condition": is_matched(F.col("condition")),
        "relation": is_matched(F.col("relation_match")),
        "outcome": F.col("outcome_match").isNull() | is_matched(F.col("outcome_match")),
        "side_effects": F.forall("side_effect_matches", is_matched),
    }
    sums = normalised.agg(F.count("*").alias("total"), *(F.count_if(c).alias(s) for s, c in ok.items()))
    stacked = ", ".join(f"'{s}', {s}" for s in ok)
    return sums.selectExpr(f"stack({len(ok)}, {stacked}) AS (slot, matched)", "total").select("slot", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), "total")


def match_rollup(normalised: DataFrame) -> DataFrame:
    """(source_id, section, slot, level, matched, total): the summary for all facts, by slot, by paper, by paper and slot and by paper, section
    and slot, in one pass over the facts; what a row sums over is null, and ``level`` tells it from a value that is null
    (bits for paper, section and slot, the last one lowest, set where it is summed over)."""
    ok = [
        ("drug", is_matched(F.col("drug"))),
        ("condition", is_matched(F.col("condition"))),
        ("relation", is_matched(F.col("relation_match"))),
        ("outcome", F.col("outcome_match").isNull() | is_matched(F.col("outcome_match"))),
        ("side_effects", F.forall("side_effect_matches", is_matched)),
    ]
    # Five counts for each paper and section first: what is expanded to five levels is small.
    counts = normalised.groupBy("source_id", "section").agg(F.count("*").alias("total"), *(F.count_if(c).alias(s) for s, c in ok))
    stacked = ", ".join(f"'{s}', {s}" for s, _ in ok)
    each = counts.selectExpr("source_id", "section", "total", f"stack({len(ok)}, {stacked}) AS (slot, matched)")
    paper, section, slot = (F.col(c) for c in ("source_id", "section", "slot"))
    levels = each.groupingSets([(), (slot,), (paper,), (paper, slot), (paper, section, slot)], paper, section, slot)
    return levels.agg(F.grouping_id().cast("int").alias("level"), F.sum("matched").alias("matched"), F.sum("total").alias("total")).select("source_id", "section", "slot", "level", "matched", "total")


def drug_coverage(normalised: DataFrame) -> DataFrame:
    return normalised.agg(F.coalesce(F.count_if(is_matched(F.col("drug"))) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("drug_coverage"))


def unmatched_report(linked: DataFrame, key: str = "fact_index", top: dict[str, int] | None = None) -> DataFrame:
    """Unmatched surfaces by slot, most frequent first, ties by first appearance; outcomes show their first 20."""
    top = {"outcome": 20} if top is None else top
    misses = linked.where("match_type = 'unmatched' AND text <> '' AND slot <> 'relation'")
    # By position first: numbers are aggregated by hash, a least struct by sorting all rows.
    placed = misses.groupBy("slot", "text", "pos").agg(F.count("*").alias("n"), F.min(key).alias(key))
    counted = placed.groupBy("slot", "text").agg(F.sum("n").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    counted = settle(counted, "counted")
    whole = counted.groupBy("slot").agg(F.count("*").alias("unique_terms"), F.sum("n").alias("total_terms"))  # a row for each slot
    ranked_ = ranked(counted, ["slot"], [F.desc("n"), F.asc("first"), F.asc("text")], "place").join(F.broadcast(whole), "slot")
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in top.items() for x in kv]), F.col("slot")), F.lit(2**31 - 1)) if top else F.lit(2**31 - 1)
    return ranked_.where(F.col("place") <= limit).select("slot", "place", "text", "n", "unique_terms", "total_terms")
