"""The corpus operators as queries over the driver's tables, by contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _public_vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of all of them, and all spans written out; n_found are those that patterns added."""
    base = F.filter("spans", lambda s: ~s["added"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).alias("n_found"), F.size("spans").cast("long").alias("n_spans"))


def id_digests(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def text_digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def chat_digests(examples: DataFrame) -> DataFrame:
    """Turns from the example that holds them all, and what the masks of all examples show, in their order."""
    from factloom.llm.chat_format import loss_text, turns_of

    told = F.when(F.col("whole"), F.array_join(F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    count = F.when(F.col("whole"), F.size(turns_of(F.col("text"))).cast("long"))
    read = examples.select("conv_id", "example", count.alias("n"), F.sha2(told, 256).alias("told"), loss_text(examples).alias("loss"), F.length("text").cast("long").alias("size"))
    each = read.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("told").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("size").alias("formatted_chars"))
    each = each.withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return each.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op1_subword_lattice(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from factloom.llm.common import fold
    from factloom.llm.lm_scoring import load_vocabulary, score_documents

    pieces = load_vocabulary(vocabulary or _public_vocabulary("piece_bpe_32k.model"))
    return score_documents(_table(spark, sf_dir, "documents"), pieces, trains=fold("doc_id") != 1)


def op2_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.decontamination import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.common import fold
    from factloom.llm.toxicity import learn, score

    documents = _table(spark, sf_dir, "documents")
    machine = learn(documents, _table(spark, sf_dir, "labels"), learns=fold("doc_id") != 0)
    scored = score(documents, machine)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.pii import find_personal_data

    return span_digests(find_personal_data(_table(spark, sf_dir, "documents")))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.topk_search import quantised, top_k

    vectors = quantised(_table(spark, sf_dir, "embeddings"), scale=256)
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.sharding import shard_documents

    out = shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_elias_fano_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from factloom.llm.token_store import read_documents, write_store

    return id_digests(read_documents(write_store(_table(spark, sf_dir, "documents"), tokenizer or _public_vocabulary("byte_bpe_50k.json"), end_id=0)))


def op9_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.substring_dedup import remove_repeats

    return text_digests(remove_repeats(_table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.hard_negatives import labelled, mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(labelled(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, scale=256, label=label))


def op12_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.chat_format import format_conversations

    control = "</s>[INST] ok [/INST]"
    one = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one)
    return chat_digests(format_conversations(rows))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % 100 in place of its own first h; h is crc32(c as text) % 6."""
    heads = turns.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    none = F.array().cast(dict(turns.dtypes)["turns"])
    first = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.prefix_trie import conversation_turns, prefix_trie

    return prefix_trie(rebuilt(conversation_turns(_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_subword_lattice, op2_benchmark_containment, op3_factorization_machine, op4_contextual_pii, op5_maxscore, op6_best_fit_sharding, op7_water_filling_mix, op8_elias_fano_tokens, op9_bottom_k_near_dedup, op10_seed_and_extend, op11_hard_negatives, op12_prefix_targets, op13_prefix_trie, pipeline)}


_WORDS = r"""list_filter(string_split_regex({text}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = """SELECT DISTINCT {id}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
FROM (SELECT {id}, {words} AS w FROM {table})"""

_CONTAINMENT = f"""WITH d AS ({_SHINGLES.format(id="doc_id", words=_WORDS.format(text=_LOWER), table="documents")}), b AS ({_SHINGLES.format(id="item_id", words=_WORDS.format(text=_LOWER), table="benchmark")}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), p AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(k AS INTEGER) AS shared, k / n AS containment FROM p JOIN n USING (item_id) WHERE k >= 0.75 * n"""

_TOP_K = """WITH q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.r <> b.r)
SELECT * EXCLUDE (r) FROM (SELECT r, query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5"""

_REPEATS = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT t, min(doc_id) AS f FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT g.doc_id, g.i, unnest(range(13)) AS k FROM g JOIN m ON m.t = g.t WHERE m.f < g.doc_id)),
x AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN c ON c.doc_id = u.doc_id AND c.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(x.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


_HARD_NEGATIVES = """WITH q AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, k FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


#: Control strings of the default template, and what a turn costs beside its role and text.
_CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
_ESCAPES = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROLS))
_CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, role || chr(10) || text AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM c),
s AS (SELECT *, sum(length(x) - 1 + {sum(map(len, _CONTROLS[:3]))} + {_ESCAPES}) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(x || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (role = 'assistant' OR k = m) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


#: crc32 by its bits: each byte is followed by eight shifts, written as -1.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
_TRIE = f"""WITH t AS (SELECT conv_id, list({{'s': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {_CRC32.format(x="conv_id")} % 6 AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS q FROM h LEFT JOIN t b ON b.conv_id = h.base),
k AS (SELECT conv_id, array_to_string(list_transform(q, lambda x: x.s), '') AS key, list_transform(q, lambda x: x.n) AS sizes FROM r),
e AS (SELECT conv_id, key, unnest(range(0, len(sizes) + 1)) AS depth, sizes FROM k),
n AS (SELECT substr(key, 1, 32 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(sizes) = depth), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
c AS (SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node),
a AS (SELECT substr(node, 1, 32 * d) AS node, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN a ON a.node = w.node LEFT JOIN w p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.node = substr(w.node, 1, 32 * (w.depth - 1))"""


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the whole result; the other queries are tested against brute force."""
    return {"op2_benchmark_containment": _CONTAINMENT, "op5_maxscore": _TOP_K, "op10_seed_and_extend": _REPEATS, "op11_hard_negatives": _HARD_NEGATIVES, "op12_prefix_targets": _CHAT, "op13_prefix_trie": _TRIE}
