"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base.  Four kinds have exact forms: e-mail addresses, IPv4 addresses, payment cards
(Luhn) and international phone numbers.  A text's pieces between matches, from
``split``, and the matches, from ``regexp_extract_all``, become rows; running sums over a text's
rows give their places, so the work grows with the text's length and no faster.

Bootstrapping.  The base spans are seeds, and so are tokens that look like secrets (SECRET: long hexadecimal
strings), a fifth kind, which the base does not have: these are reported only where a pattern finds them.
An identifier is a token with a digit or an at sign.  Its lexical patterns are the word to its left, the
two words to its left, the words on both sides (lower-cased, digits as 9), or the label that it carries
itself (``id=``, ``tel:``).  Patterns and the identifiers they stand around form a bipartite graph, scored in rounds: a
pattern's confidence in a kind is the part of its distinct identifiers' confidence in that kind; an identifier's is the
noisy-or over its patterns'; seeds stay at 1, and identifiers found in one round lend
trust to patterns without a seed in the next.  A pattern counts only with SUPPORT
distinct identifiers or more, if its identifiers are mostly of one kind, and if most
occurrences of its words in the whole corpus stand around an identifier: a word such as
"the" is no pattern however many addresses follow it.  Identifiers in a pattern
that is still confident after the last round are found, with the kind of their most confident pattern.

The forms are written so that Java's matcher needs neither recursion nor a second look at
a character run: possessive loops, and runs entered at their start or where the last match
ended; they match what the plain forms match.

Defined cases: a null text is an empty one and has no spans; repeated rows are each
returned; spans count code points; a found span that overlaps a base span is dropped; of patterns with
equal confidence the kind listed first counts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import settle, texts

KINDS = ("email", "ip", "card", "phone")
#: The kinds of found spans: the base's, then those that have seeds only.
FOUND_KINDS = (*KINDS, "secret")
_WORD = r"[^\x20\x09-\x0D]"
#: What a text must hold for a form to match at all, and the form.
FORMS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
IDENTIFIER = rf"(?<!{_WORD}){_WORD}*[0-9@]{_WORD}*"
#: A secret's value: 32 hexadecimal digits or more, letters and figures among them.
SECRET = r"^(?=[0-9]*+[a-fA-F])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,}+$"
LABEL = r"^([A-Za-z][A-Za-z_.-]*[=:])(?=.)"
#: Stands for the identifier between the words of a two-sided pattern; no word is equal to it.
GAP = "\x01"
ROUNDS, SUPPORT, PRECISION, SPECIFIC = 3, 3, 0.5, 0.5
#: Most patterns that are broadcast (about 100 bytes each); beyond, all words are counted.
BROADCAST_PATTERNS = 200_000


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    double = lambda c: F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(double(c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, c: a + c) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        size = F.length(_digits(found))
        return F.when(size.between(12, 19), _luhn(_digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _pieces(docs: DataFrame) -> DataFrame:
    """(row, doc_id, matches): for the base kinds and, as kind 4, identifiers every match in order: the length of the gap
    before it, its own, what was found, and of identifiers the two words to the left and the word to the right."""
    names, forms = [], []
    for k, form in enumerate([*(FORMS[kind][1] for kind in KINDS), IDENTIFIER]):
        needs = FORMS[KINDS[k]][0] if k < len(KINDS) else "[0-9@]"
        there = F.contains("text", F.lit(needs)) if needs == "@" else F.col("text").rlike(needs)
        none = F.array().cast("array<string>")
        forms += [F.when(there, F.split("text", form, -1)).otherwise(none).alias(f"gaps{k}"), F.when(there, F.regexp_extract_all("text", F.lit(form), F.lit(0))).otherwise(none).alias(f"found{k}")]
        names.append((k, f"gaps{k}", f"found{k}"))
    cut = docs.select(F.expr("uuid()").alias("row"), "doc_id", *forms)
    kind = "array<struct<kind_no:int,place:int,gap:int,size:int,found:string,left:string,left2:string,right:string>>"

    def listed(k: int, gaps: str, found: str) -> Column:
        def one(f: Column, i: Column) -> Column:
            words = [F.lit(None).cast("string")] * 3
            if k == len(KINDS):
                before = F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i))
                after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))
                last = rf"(?<!{_WORD})({_WORD}++)[\x20\x09-\x0D]*+$"
                words = [F.regexp_extract(before, last, 1), F.regexp_extract(before, rf"(?<!{_WORD})({_WORD}++)[\x20\x09-\x0D]++{_WORD}++[\x20\x09-\x0D]*+$", 1), F.regexp_extract(after, rf"^[\x20\x09-\x0D]*+({_WORD}++)", 1)]
            return F.struct(F.lit(k).alias("kind_no"), i.alias("place"), F.length(F.get(gaps, i)).alias("gap"), F.length(f).alias("size"), f.alias("found"), *(w.alias(n) for w, n in zip(words, ("left", "left2", "right"), strict=True)))

        return F.transform(found, one).cast(kind)

    return cut.select("row", "doc_id", F.concat(*(listed(*n) for n in names)).alias("matches"))


def _placed(rows: DataFrame) -> DataFrame:
    """(row, kind_no, start, end, found, left, left2, right), one row for each match."""
    each = rows.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    so_far = Window.partitionBy("row", "kind_no").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    return each.select("row", "kind_no", (end - F.col("size")).alias("start"), end.alias("end"), "found", "left", "left2", "right")


def base_spans(placed: DataFrame) -> DataFrame:
    """The valid matches of the exact forms: (row, kind_no, start, end, found)."""
    valid = F.lit(False)
    for k, kind in enumerate(KINDS):
        valid = F.when(F.col("kind_no") == k, _valid(kind, F.col("found"))).otherwise(valid)
    return placed.where(F.col("kind_no") < len(KINDS)).where(valid).select("row", "kind_no", "start", "end", "found")


def identifiers(placed: DataFrame) -> DataFrame:
    """Tokens with a digit or an at sign: (row, start, end, value, labelled, patterns)."""
    label = F.regexp_extract("found", LABEL, 1)
    tokens = placed.where(F.col("kind_no") == len(KINDS)).withColumn("label", label).withColumn("body", F.substr("found", F.length("label") + 1))
    tokens = tokens.withColumn("lead", F.length(F.regexp_extract("body", r"^[^\p{L}0-9+@]*+", 0))).withColumn("value", F.regexp_replace("body", r"^[^\p{L}0-9+@]+|(?<![^\p{L}0-9])[^\p{L}0-9]++$", ""))
    start = F.col("start") + F.length("label") + F.col("lead")
    plain = lambda *w: F.regexp_replace(F.lower(F.concat_ws(" ", *w)), "[0-9]", "9")
    around = F.array(F.when(F.col("left") != "", plain(F.col("left"))), F.when(F.col("left2") != "", plain(F.col("left2"), F.col("left"))), F.when((F.col("left") != "") & (F.col("right") != ""), plain(F.col("left"), F.lit(GAP), F.col("right"))))
    patterns = F.when(F.col("label") != "", F.array(plain(F.col("label")))).otherwise(F.filter(around, lambda p: p.isNotNull()))
    return tokens.where("value <> ''").select("row", start.alias("start"), (start + F.length("value")).alias("end"), "value", (F.col("label") != "").alias("labelled"), patterns.alias("patterns"))


def seeded(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """The tokens with ``seed``, the kind of the first base span that starts in them, whose text is then their value, or that of
    a secret; tokens that a base span reaches into from the left are the rest of a seed and left out."""
    events = tokens.select("row", "start", "end", "value", "labelled", "patterns", F.lit(None).cast("int").alias("kind_no")).unionByName(base.select("row", "start", "end", F.col("found").alias("value"), F.lit(False).alias("labelled"), F.array().cast("array<string>").alias("patterns"), "kind_no"))
    is_base = F.col("kind_no").isNotNull()
    # Of events at one start the spans come after the tokens, seen from either side: a span at the token's start is its seed.
    ahead = Window.partitionBy("row").orderBy("start", is_base).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(is_base), F.desc("kind_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.when(is_base, F.struct("start", "kind_no", F.col("value").alias("found")))
    events = events.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(ahead)).withColumn("next", F.last(span, ignorenulls=True).over(behind))
    own = events.where(~is_base & (F.col("reach").isNull() | (F.col("reach") <= F.col("start")))).withColumn("seed", F.when(F.col("next.start") < F.col("end"), F.col("next.kind_no")))
    value = F.when(F.col("seed").isNotNull(), F.col("next.found")).otherwise(F.col("value"))
    seed = F.when(F.col("seed").isNotNull(), F.col("seed")).when(F.col("value").rlike(SECRET), F.lit(len(KINDS)))
    return own.select("row", "start", "end", value.alias("value"), "labelled", "patterns", seed.alias("seed"))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, all): how often the words of each pattern stand in the corpus as they stand around an identifier."""
    few = patterns.count() <= BROADCAST_PATTERNS
    checked = lambda df: F.broadcast(df) if few else df
    words = docs.select(F.filter(F.split(F.regexp_replace(F.lower("text"), "[0-9]", "9"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    # The outer form: for the inner one Catalyst infers a filter that splits every text once more.
    each = words.select(F.explode_outer(F.transform("w", lambda w, i: F.struct(w.alias("word"), F.get("w", i + 1).alias("second"), F.get("w", i + 2).alias("third")))).alias("at")).where("at IS NOT NULL").select("at.*")
    each = each.join(checked(patterns.select(F.element_at(F.split("pattern", " "), 1).alias("word")).distinct()), "word", "left_semi")
    made = F.array("word", F.concat("word", F.lit(" "), "second"), F.concat("word", F.lit(f" {GAP} "), "third"))
    return each.select(F.explode(made).alias("pattern")).join(checked(patterns.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("all"))


def confident_patterns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(pattern, kind_no, confidence) of the patterns that are confident in a kind after the last round.
    ``found`` has (patterns, labelled, value, seed: kind_no or null), a row for each identifier in the corpus."""
    each = found.select(F.explode("patterns").alias("pattern"), "value", "seed", "labelled")
    edges = settle(each.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max("labelled").alias("labelled")), "edges")
    support = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("before"), F.max("labelled").alias("labelled"))
    support = settle(support.where(F.col("values") >= SUPPORT), "support")
    occurs = F.coalesce(F.when(~F.col("labelled"), F.col("all")), F.col("before"))
    specific = support.join(occurrences(docs, support.where("NOT labelled")), "pattern", "left").where(F.col("before") >= SPECIFIC * occurs).select("pattern")
    edges = settle(edges.join(settle(specific, "specific"), "pattern").select("pattern", "value", "seed"), "graph")
    seeds = settle(edges.where("seed IS NOT NULL").groupBy("value").agg(F.max("seed").alias("kind_no")).withColumn("trust", F.lit(1.0)), "seeds")
    instances, patterns = seeds, None
    for _ in range(ROUNDS):
        held = edges.join(instances, "value", "left").groupBy("pattern", "kind_no").agg(F.sum(F.coalesce("trust", F.lit(0.0))).alias("trust"), F.count("*").alias("n"))
        totals = held.groupBy("pattern").agg(F.sum("n").alias("total"), F.max(F.struct("trust", -F.col("kind_no"))).alias("best"))
        patterns = totals.select("pattern", (-F.col("best.col2")).alias("kind_no"), (F.col("best.trust") / F.col("total")).alias("confidence"))
        patterns = settle(patterns.where((F.col("confidence") >= PRECISION) & F.col("kind_no").isNotNull()), "patterns")
        scored = edges.join(patterns, "pattern").groupBy("value", "kind_no").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("trust"))
        best = scored.join(seeds, "value", "left_anti").groupBy("value").agg(F.max(F.struct("trust", -F.col("kind_no"))).alias("best"))
        instances = settle(seeds.unionByName(best.select("value", (-F.col("best.col2")).alias("kind_no"), F.greatest("best.trust", F.lit(0.0)).alias("trust"))), "instances")
    return patterns


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end, added) by start, then kind as in FOUND_KINDS; code points,
    end exclusive; ``added`` marks what patterns found beside the base spans."""
    docs = texts(documents, id_col, text_col)
    rows = settle(_pieces(docs), "pieces")
    placed = _placed(rows)
    base = settle(base_spans(placed), "base")
    found = settle(seeded(base, identifiers(placed)), "identifiers")
    patterns = confident_patterns(found, docs).withColumnRenamed("kind_no", "pattern_kind")
    open_ = found.where(F.col("seed").isNull() | (F.col("seed") >= len(KINDS))).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    added = open_.join(patterns, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", -F.col("pattern_kind"))).alias("best"))
    added = added.select("row", "start", (-F.col("best.col2")).alias("kind_no"), "end", F.lit(True).alias("added"))
    every = base.select("row", "start", "kind_no", "end", F.lit(False).alias("added")).unionByName(added)
    spans = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "added"))).alias("s"))
    kinds = F.array(*(F.lit(k) for k in FOUND_KINDS))
    named = F.transform("s", lambda s: F.struct(F.get(kinds, s["kind_no"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["added"].alias("added")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,added:boolean>>")
    return rows.select("row", "doc_id").join(settle(spans, "spans"), "row", "left").select("doc_id", F.coalesce(named, none).alias("spans"))
