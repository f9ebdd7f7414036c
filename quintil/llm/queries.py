"""The registered queries of the text operators; SQL twins where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintil.llm import contentsort, decontaminate, html, lines, passages, pieces, ppm, prefixtrie, quality, rules, simhash, toolcalls, variants
from quintil.llm.text import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}
MODEL_NAME = "piece_bpe_32k.model"


def model_path(name: str = MODEL_NAME) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


@register
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@register
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from preference pairs of labelled ones."""
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that start in a smaller one."""
    cut = passages.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and text digests of every document under the public BPE vocabulary."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model_path())


@register
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that occur in them, edits included."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register
def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and byte-trie log probabilities of every document."""
    return ppm.score(read_table(spark, sf_dir, "documents"))


@register
def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of repeated runs of lines."""
    cut = lines.remove_repeated_lines(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


TWINS["op7_line_runs"] = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), cells AS (
  SELECT doc_id, i AS ln, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), worded AS (
  SELECT doc_id, ln, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS p,
    sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS c
  FROM cells WHERE w > 0
), listed AS (
  SELECT doc_id, list(line ORDER BY p) AS seq FROM worded GROUP BY doc_id
), windows AS (
  SELECT s.doc_id, s.p AS a, e.p AS b FROM worded s JOIN worded e ON s.doc_id = e.doc_id
  WHERE e.c - (s.c - s.w) >= 50 AND (e.c - e.w - (s.c - s.w) < 50 OR e.c - s.c < 50) AND e.p >= s.p
), named AS (
  SELECT doc_id, a, b, array_to_string(seq[a:b], chr(10)) AS content FROM windows JOIN listed USING (doc_id)
), later AS (
  SELECT doc_id, a, b FROM (
    SELECT *, min((doc_id, a)) OVER (PARTITION BY content) AS fst FROM named
  ) WHERE (doc_id, a) > fst
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM later
), kept AS (
  SELECT c.doc_id, c.ln, c.line, w.p IS NOT NULL AS has_word, g.p IS NOT NULL AS lost
  FROM cells c LEFT JOIN worded w ON c.doc_id = w.doc_id AND c.ln = w.ln
  LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p
)
SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (lost) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT lost), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


@register
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and its verdict by robust distance within language and source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.judge(docs).drop("lang", "source")


@register
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = html.extract(read_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_shared")


@register
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as tool traffic: each question a call that refers to the one before, each answer its result."""
    talk = read_table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), turn)
    arguments = F.struct(F.when(F.col("turn") >= 2, F.concat(F.lit("$"), name(F.col("turn") - 2))).alias("after"), F.col("text").alias("question"))
    call = F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"))).alias("tool_calls"))
    result = F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    text = F.when(F.col("role") == "user", F.to_json(call)).when(F.col("role") == "assistant", F.to_json(result)).otherwise(F.col("text"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    schemas = spark.createDataFrame([("answer", "question", "string", True), ("answer", "after", "string", False)], "name string, argument string, kind string, required boolean")
    found = toolcalls.format_chat(talk.select("conv_id", "turn", role.alias("role"), text.alias("text")), schemas)
    place = [F.col("place.turn").alias("place_turn"), F.col("place.step").alias("place_step")]
    return found.select("conv_id", "kind", *place, "turn", "call_id", F.array_join("errors", " ").alias("errors"), "json")


TWINS["op10_tool_calls"] = r"""
WITH asked AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '_' || turn AS id,
    CASE WHEN turn >= 2 THEN 'c' || conv_id || '_' || (turn - 2) END AS need
  FROM conversations WHERE role = 'user'
), answers AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '_' || (turn - 1) AS id FROM conversations WHERE role = 'assistant'
), calls AS (
  SELECT a.conv_id, a.turn, a.id, CASE WHEN a.need IS NOT NULL AND b.id IS NULL THEN 'reference:' || a.need ELSE '' END AS errors,
    '{"arguments":{' || CASE WHEN a.need IS NOT NULL THEN '"after":"$' || a.need || '",' ELSE '' END
    || '"question":' || to_json(a.text) || '}'
    || CASE WHEN a.need IS NOT NULL AND b.id IS NULL THEN ',"errors":["reference:' || a.need || '"]' ELSE '' END
    || ',"id":"' || a.id || '","name":"answer"' || CASE WHEN r.id IS NOT NULL THEN ',"result":' || to_json(r.text) ELSE '' END || '}' AS json
  FROM asked a LEFT JOIN asked b ON a.conv_id = b.conv_id AND a.need = b.id LEFT JOIN answers r ON a.conv_id = r.conv_id AND a.id = r.id
), rest AS (
  SELECT conv_id, turn, NULL AS id, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json
  FROM conversations WHERE role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT r.conv_id, r.turn, r.id,
    '{"content":' || to_json('{"tool_call_id":' || to_json(r.id) || ',"content":' || to_json(r.text) || '}') || ',"role":"tool"}'
  FROM answers r LEFT JOIN asked a ON a.conv_id = r.conv_id AND a.id = r.id WHERE a.id IS NULL
)
SELECT conv_id, 'call' AS kind, CAST(turn AS BIGINT) AS place_turn, CAST(0 AS BIGINT) AS place_step, turn, id AS call_id, errors, json FROM calls
UNION ALL
SELECT conv_id, 'message', CAST(turn AS BIGINT), CAST(0 AS BIGINT), turn, id, '', json FROM rest
"""


# crc32 as SQL: ``table`` of 256 remainders made from the reversed polynomial, then one step a byte.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS remainders
)"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 in a query over ``crc``."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, remainders[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295)"


@register
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with the far more frequent word one edit away, and the last of such a chain."""
    runs = variants.runs_of(read_table(spark, sf_dir, "documents"))
    words = runs.select(variants.damaged(F.col("doc_id"), F.col("run"), 199).alias("word"))
    return variants.group_variants(variants.vocabulary(words, min_length=6, min_count=5), ratio=5)


TWINS["op11_spelling_variants"] = (
    f"WITH RECURSIVE {CRC_TABLE}"
    + r""", runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
), counted AS (
  SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, """
    + crc_sql("coalesce(doc_id::VARCHAR, 'null') || ':' || run")
    + r""" AS h FROM counted, crc
), damaged AS (
  SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, w := other)) AS b FROM near GROUP BY word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.w END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), followed AS (
  SELECT word, word AS top FROM formed
  UNION ALL SELECT followed.word, form FROM followed JOIN formed ON followed.top = formed.word WHERE form IS NOT NULL
), roots AS (
  SELECT followed.word, top AS root FROM followed JOIN formed ON followed.top = formed.word WHERE form IS NULL
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN roots ON formed.word = roots.word
"""
)


@register
def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of all equal texts."""
    return contentsort.mark_copies(read_table(spark, sf_dir, "documents"), keep="largest")


TWINS["op12_content_sort"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def rebuilt(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin with the first turns of the conversation at the start of their twenty, and all ids."""
    ids = items.select("conv_id").distinct().withColumns(
        {"base": F.col("conv_id") - F.col("conv_id") % 20, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4}
    )
    heads = items.where("position < 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count("*").alias("held"))
    known = ids.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("held", F.lit(0))))
    own = items.join(known.select("conv_id", "h", "m"), "conv_id").where("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("m")).alias("position"), "item", "words")
    borrowed = ids.join(heads, "base").where("position < h").select("conv_id", "position", "item", "words")
    return own.unionByName(borrowed), ids.select("conv_id")


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its subtree's totals."""
    turns, ids = rebuilt(prefixtrie.turn_items(read_table(spark, sf_dir, "conversations")))
    return prefixtrie.build(turns, ids).drop("node", "parent")


TWINS["op13_prefix_trie"] = (
    f"WITH RECURSIVE {CRC_TABLE}"
    + r""", turns AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), held AS (
  SELECT conv_id, list(turn ORDER BY k) AS seq FROM turns GROUP BY conv_id
), sized AS (
  SELECT conv_id, seq, """
    + crc_sql("conv_id::VARCHAR")
    + r""" % 4 AS h FROM held, crc
), talks AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq, [])[1:c.h], c.seq[c.h + 1:]) AS seq
  FROM sized c LEFT JOIN held b ON b.conv_id = c.conv_id - c.conv_id % 20
), steps AS (
  SELECT conv_id, seq[1:d] AS path, d, len(seq) = d AS at_end FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM talks)
), nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) END AS own
  FROM steps GROUP BY path, d
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY depth, conv_id) AS id FROM nodes
), linked AS (
  SELECT c.*, p.id AS up, p.conv_id AS parent_conv_id FROM numbered c LEFT JOIN numbered p ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path
), children AS (
  SELECT up, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY up
), lifted AS (
  SELECT id, up, id AS source FROM linked
  UNION ALL SELECT l.id, l.up, lifted.source FROM lifted JOIN linked l ON l.id = lifted.up
), totals AS (
  SELECT t.id, sum(s.own)::BIGINT AS saved_tokens, count(*) FILTER (k.up IS NULL) AS n_leaves
  FROM lifted t JOIN linked s ON s.id = t.source LEFT JOIN children k ON k.up = t.source GROUP BY t.id
)
SELECT linked.conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN totals ON totals.id = linked.id LEFT JOIN children ON children.up = linked.id
"""
)
