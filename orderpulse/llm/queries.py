"""The registered queries of the numbered operators, one for each, with SQL counterparts where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from orderpulse.llm import chat, decontaminate, embeddings, html, katz, licenses, packing, quality, rangecoder, separators, simhash, spelling, whitening
from orderpulse.llm.common import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows of an Arrow batch: a text may be long, and a task holds a few batches at once.
BATCH_ROWS = "2000"


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@register
def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the trigram Katz model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs.withColumn("held", katz.held_out(F.col("doc_id"))), order=3)


@register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against every benchmark window."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    each = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return each.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op2_benchmark_decontamination"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), docs AS (SELECT row_number() OVER () AS row_id, * FROM split),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS (SELECT row_id, i, size, item_id FROM places JOIN (SELECT size, win, item_id FROM wins) USING (size, win)),
covered AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row_id),
held AS (
  SELECT row_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN held USING (row_id)
"""


@register
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = settle(simhash.fingerprints(docs).select("doc_id", "fp"), "fingerprinted")
    return marked.join(simhash.groups(marked), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


@register
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


@register
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, within its label."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLES["op3_embedding_near_dedup"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


@register
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and length of every document in the token files of `documents`, found by their end ids."""
    end = 50256
    blocks, names = separators.write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end)
    return separators.documents(blocks, end).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


@register
def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen; rejected has the last answer of the conversation with the next id instead of its own."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where(F.col("role") == chat.ASSISTANT).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.struct(F.col("own.text").alias("text")).alias("other"))
    answers = last.select("pair_id", F.col("own.turn").alias("at")).join(other, "pair_id", "left")
    replaced = F.coalesce((F.col("role") == chat.ASSISTANT) & F.col("turn").eqNullSafe(F.col("at")), F.lit(False))
    rejected = turns.join(answers, "pair_id", "left").where(~replaced | F.col("other").isNotNull())
    rejected = rejected.select("pair_id", "turn", "role", F.when(replaced, F.col("other.text")).otherwise(F.col("text")).alias("text"))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["a"].cast("string"), s["z"].cast("string"))), ",")
    return chat.preference_pairs(turns, rejected).withColumns({"chosen_mask": ranges("chosen_mask"), "rejected_mask": ranges("rejected_mask")})


ORACLES["op7_preference_formatting"] = r"""
WITH own AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS own FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
marked AS (
  SELECT x.conv_id, x.turn, x.role, x.text, other.own.text AS answer, other.conv_id IS NOT NULL AS has_other,
    x.role IS NOT DISTINCT FROM 'assistant' AND own.conv_id IS NOT NULL AND x.turn IS NOT DISTINCT FROM own.own.turn AS replaced
  FROM conversations x LEFT JOIN own ON own.conv_id = x.conv_id LEFT JOIN own other ON other.conv_id = x.conv_id + 1 AND own.conv_id IS NOT NULL
), sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, 1, turn, role, CASE WHEN replaced THEN answer ELSE text END FROM marked WHERE conv_id IS NOT NULL AND (NOT replaced OR has_other)
), t AS (
  SELECT pair_id, side, role, text,
    row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    '<|' || replace(coalesce(role, ''), '<|', '<\|') || '|>' || chr(10) AS head,
    replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' || chr(10) AS body
  FROM sides
), c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id),
differ AS (
  SELECT c.pair_id, min(c.k) AS k FROM c JOIN r ON c.pair_id = r.pair_id AND c.k = r.k
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id
), cut AS (SELECT pair_id, nc, nr, coalesce(k - 1, least(nc, nr)) AS n FROM sizes LEFT JOIN differ USING (pair_id)),
rest AS (
  SELECT t.*, n, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side ORDER BY k) AS z
  FROM t JOIN cut USING (pair_id) WHERE k > n
), made AS (
  SELECT pair_id, side, string_agg(head || body, '' ORDER BY k) AS txt,
    string_agg((z - length(body))::VARCHAR || '-' || (z - 1)::VARCHAR, ',' ORDER BY k) FILTER (role = 'assistant') AS mask
  FROM rest GROUP BY pair_id, side
), prompts AS (SELECT pair_id, string_agg(head || body, '' ORDER BY k) AS txt FROM t JOIN cut USING (pair_id) WHERE k <= n AND side = 0 GROUP BY pair_id)
SELECT cut.pair_id, coalesce(p.txt, '') AS prompt, coalesce(a.txt, '') AS chosen, coalesce(b.txt, '') AS rejected,
  coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask,
  n AS prompt_turns, nc - n AS chosen_turns, nr - n AS rejected_turns, n > 0 AND a.mask IS NOT NULL AND b.mask IS NOT NULL AS usable
FROM cut LEFT JOIN prompts p USING (pair_id) LEFT JOIN made a ON a.pair_id = cut.pair_id AND a.side = 0 LEFT JOIN made b ON b.pair_id = cut.pair_id AND b.side = 1
"""


@register
def op8_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, read back from the token files."""
    files = rangecoder.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return rangecoder.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents that occurs twice or more."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS steps FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY id, run),
bytes AS (
  SELECT run, c, flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)) AS b
  FROM counted
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a // 256, steps[xor(a % 256, x) + 1])), 4294967295) AS h
  FROM bytes, crc
), made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed
), vocabulary AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, length(word) AS len, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
holes AS (SELECT word, n, len, i, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS tail FROM places),
shorter AS (SELECT DISTINCT v.word AS a, v.n AS a_n, h.word AS b, h.n AS b_n FROM holes h JOIN vocabulary v ON v.word = h.head || h.tail),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.len = b.len AND a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT a, b, b_n FROM shorter UNION ALL SELECT b, a, a_n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word
), top AS (SELECT near.word, min(other) AS top FROM near JOIN best ON near.word = best.word AND other_n = top_n GROUP BY near.word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word) LEFT JOIN top USING (word)
), chain(word, cur, step) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN forms f ON f.word = chain.cur WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(cur, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""


@register
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _license_sql() -> str:
    """Every template as a regular expression over words with a space in front; phrases by comparing lists of words."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    cut = lambda text: re.findall("[0-9a-z]+", text.lower())

    def expression(text: str) -> str:
        parts = re.split(r"<<(optional|end|any \d+)>>", text)
        write = lambda part: "(?:" if part == "optional" else ")?" if part == "end" else f"(?: [^ ]+){{0,{part[4:]}}}"
        return "".join(write(part) if k % 2 else "".join(f" {w}" for w in cut(part)) for k, part in enumerate(parts)) + "( |$)"

    def mandatory(text: str) -> int:
        depth = size = 0
        for k, part in enumerate(re.split(r"<<(optional|end|any \d+)>>", text)):
            depth += (part == "optional") - (part == "end") if k % 2 else 0
            size += len(cut(part)) if not k % 2 and not depth else 0
        return size

    base = ", ".join(f"({quoted(label)}, {cut(text)!r})" for text, label in licenses.BASE)
    rules = ", ".join(f"({quoted(label)}, {quoted(expression(text))}, {mandatory(text)})" for text, label in [*licenses.BASE, *licenses.TEMPLATES])
    return rf"""
WITH phrases(label, p) AS (VALUES {base}), rules(label, rule, size) AS (VALUES {rules}),
docs AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (SELECT k, label, i FROM (SELECT k, label, w, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs, phrases) WHERE w[i:i + len(p) - 1] = p),
counted AS (SELECT k, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY k),
matched AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(size) AS size FROM docs, rules WHERE regexp_matches(' ' || array_to_string(w, ' '), rule) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(counted.labels, '') AS base_labels, coalesce(matched.labels, '') AS labels, coalesce(size / (size + 4.0)::DOUBLE, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN counted USING (k) LEFT JOIN matched USING (k)
"""


ORACLES["op12_license_scan"] = _license_sql()


@register
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector, fitted on all different ones."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
