"""Documents into sections and sentences.

Everything is an expression over one row: headings and sentence ends are found by patterns, and sections and
sentences are the pieces between them, so splitting needs no shuffle and a text of twice the length takes twice the time.
(Arrays are exploded in the outer form: for the inner one Catalyst infers a filter that works them out once more.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.arrays import with_running_sums
from factloom.functions.text import section_name, strip

_LINE_ENDS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029"
_LINE_END = rf"\r\n|[{_LINE_ENDS}]"
#: A line whose first character that is not white space is a number sign, with its end.
_HEADING = rf"(?:\A|(?<=[{_LINE_ENDS}]))[\t\x1F\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]*+#[^{_LINE_ENDS}]*+(?:\r\n|[{_LINE_ENDS}]|\z)"
_SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z(])"


def _sections(markdown: Column) -> Column:
    """Array of (name, text): the pieces between headings, each with the heading before it."""
    headings = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(markdown, F.lit(_HEADING), F.lit(0)))
    pieces = F.arrays_zip(F.split(markdown, _HEADING, -1).alias("body"), headings.alias("heading"))

    def one(x: Column) -> Column:
        title = strip(F.regexp_replace(F.regexp_replace(x["heading"], _LINE_END, ""), r"(?U)^#+\s*", ""))
        name = F.when(x["heading"].isNull(), "Document").when(title != "", title).otherwise("Section")
        return F.struct(name.alias("name"), strip(F.regexp_replace(F.coalesce(x["body"], F.lit("")), _LINE_END, "\n")).alias("text"))

    return F.filter(F.transform(pieces, one), lambda s: s["text"] != "")


def split_sections(documents: DataFrame, id_col: str = "source_id", markdown_col: str = "markdown", full_text_col: str | None = None) -> DataFrame:
    """(source_id, section_seq, raw_name, name, text, start_offset, end_offset).

    Offsets are those of the section's text in the full text (by default the Markdown itself);
    a text that is not found there starts at its end.  (Each is looked for from the beginning, where
    an equal text may stand: the only step that costs more than the document's length.)
    """
    full = F.coalesce(F.col(full_text_col or markdown_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("source_id"), full.alias("full_text"), _sections(F.coalesce(F.col(markdown_col), F.lit(""))).alias("s"))
    # The place is looked for before the explode, which would copy the full text to every section's row.
    placed = F.transform("s", lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"), F.position(s["text"], F.col("full_text")).alias("at")))
    rows = rows.withColumn("n", F.length("full_text")).select("source_id", "n", F.posexplode_outer(placed).alias("section_seq", "s")).where("s IS NOT NULL")
    start = F.when(F.col("s.at") == 0, F.col("n")).otherwise(F.col("s.at") - 1)
    return rows.select("source_id", "section_seq", F.col("s.name").alias("raw_name"), section_name("s.name").alias("name"), F.col("s.text").alias("text"), start.alias("start_offset"), (start + F.length("s.text")).alias("end_offset"))


def with_sentences(rows: DataFrame, text_col: str = "text", base: Column | None = None) -> DataFrame:
    """Adds ``sentences``, an array of (text, start, end): offsets are those of the piece between two sentence ends, untrimmed."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    cut = rows.withColumns({"_base": F.lit(0) if base is None else base.cast("int"), "_pieces": F.split(body, _SENTENCE_END, -1), "_gaps": F.regexp_extract_all(body, F.lit(_SENTENCE_END), F.lit(0))})
    cut = cut.withColumn("_sizes", F.zip_with("_pieces", "_gaps", lambda p, g: F.length(p) + F.length(F.coalesce(g, F.lit("")))))
    cut = with_running_sums(cut, "_sizes", "_ends")

    def one(x: Column) -> Column:
        start = F.col("_base") + x["_ends"] - x["_sizes"]
        return F.struct(strip(x["_pieces"]).alias("text"), start.alias("start"), (start + F.length(x["_pieces"])).alias("end"))

    found = F.filter(F.transform(F.arrays_zip("_pieces", "_sizes", "_ends"), one), lambda s: s["text"] != "")
    return cut.withColumn("sentences", found).drop("_base", "_pieces", "_gaps", "_sizes", "_ends")


def split_sentences(sections: DataFrame, keys: list[str], text_col: str = "text", base: Column | None = None) -> DataFrame:
    """(*keys, sent_seq, sentence, start, end), one row for each sentence."""
    rows = with_sentences(sections, text_col, base).select(*keys, F.posexplode_outer("sentences").alias("sent_seq", "s")).where("s IS NOT NULL")
    return rows.select(*keys, "sent_seq", F.col("s.text").alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def parsed_documents(documents: DataFrame, id_col: str = "source_id", markdown_col: str = "markdown", full_text_col: str | None = None) -> DataFrame:
    """(source_id, full_text, sections): the nested form, built back from the sections of each document."""
    sections = split_sections(documents, id_col, markdown_col, full_text_col)
    nested = with_sentences(sections, base=F.col("start_offset"))
    grouped = nested.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("section_seq", "name", "text", "start_offset", "end_offset", "sentences"))).alias("sections"))
    return documents.select(F.col(id_col).alias("source_id"), F.col(full_text_col or markdown_col).alias("full_text")).join(grouped, "source_id", "left")
