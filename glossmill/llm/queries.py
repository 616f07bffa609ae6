"""The registered queries of this folder's operators, and their SQL where SQL can say the same.

Each query takes (spark, sf_dir), applies its operator to whole tables, and
derives the digest columns of its contract from the operator's own output.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, media, packing, quality, repair, search, sharding, simhash, store, substrings, tokenfiles, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2048, end_id=1)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_folder(spark, "tiles")
    media.write_tiles(table(spark, sf_dir, "documents"), path, "doc_id", "text", to_image=media.text_image)
    return media.describe(spark.read.parquet(path)).withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, split = store.new_folder(spark, "warc-whole"), store.new_folder(spark, "warc")
    written = warc.write_monolithic(warc.decide(table(spark, sf_dir, "pages").select("page_id", "url", "html")), whole)
    return warc.read(warc.normalise(written, split, remove=True))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's operator over all conversations, each message quoting, by a rule that the SQL states too, the first lines of the two before it.

    The tables' own messages quote nothing.
    """
    messages = table(spark, sf_dir, "conversations")
    said = messages.groupBy("conv_id", "turn").agg(F.min(F.substring_index("text", "\n", 1)).alias("said"))
    before = [said.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.col("said").alias(f"said{k}")) for k in (1, 2)]
    for k, rows in enumerate(before, 1):
        messages = messages.join(rows, (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}")), "left")
    text = F.when(F.col("text").isNotNull(), F.concat_ws("\n", F.concat(F.lit("> "), "said1"), F.concat(F.lit("> > "), "said2"), "text"))
    return chat.conversations(messages.select("conv_id", "turn", "role", text.alias("text")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    sharded = sharding.shard_by_bytes(rows, ["doc_id", "text_crc32"], "size", 16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).drop("text")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_folder(spark, "token-ids")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, end_id=0)
    return tokenfiles.digests(spark, path).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = substrings.remove_repeats(docs.select("doc_id", "text"))
    return cut.select("doc_id", "text", F.col("removed").alias("cut_spans"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def damaged(messages: DataFrame) -> DataFrame:
    """Conversations with faults by rule: rows that go are marked absent, texts are emptied or lose their stops, rows are repeated, roles changed."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = messages.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (fault == 0).alias("absent"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair.repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), absent="absent")
    return repair.summaries(repaired).withColumnRenamed("conv", "conv_id")


def queries() -> dict:
    """All functions here named op…, and chat_quotes."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"chat_quotes": chat_quotes}


SQL_OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
best AS (SELECT b, max(page_id) AS kept FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT p.page_id AS page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
       CASE WHEN kept <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> p.page_id THEN kept END AS refers_to
FROM p LEFT JOIN best ON p.b = best.b
"""

SQL_OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))
), grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), occ AS (
  SELECT doc_id, s, g.n AS n, item_id FROM grams g JOIN windows USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


SQL_OP6 = r"""
WITH RECURSIVE l AS (
  SELECT *, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(substr(line, length(mark) + 1)), '\s+', ' ', 'g')) AS norm
  FROM (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS mark
        FROM (SELECT conv_id, turn, text, i, string_split(text, chr(10))[i] AS line
              FROM (SELECT conv_id, turn, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL))))
), runs AS (
  SELECT *, sum(CASE WHEN norm = '' OR level IS DISTINCT FROM plevel OR pnorm = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, text ORDER BY i) AS run
  FROM (SELECT *, lag(level) OVER w AS plevel, lag(norm) OVER w AS pnorm FROM l WINDOW w AS (PARTITION BY conv_id, turn, text ORDER BY i))
), grouped AS (
  SELECT conv_id, turn, level, list(norm ORDER BY i) AS parts FROM runs WHERE norm <> '' GROUP BY conv_id, turn, text, run, level
), passages AS (
  SELECT DISTINCT conv_id, turn, level, true AS whole, array_to_string(parts, ' ') AS norm FROM grouped
  UNION SELECT DISTINCT conv_id, turn, level, false, unnest(parts) FROM grouped WHERE len(parts) > 1
), said AS (
  SELECT conv_id, norm, min(turn) AS original FROM passages WHERE level = 0 GROUP BY conv_id, norm
), best AS (
  SELECT conv_id, turn, level, coalesce(max(original) FILTER (whole), max(original)) AS original, count(*) AS n
  FROM passages JOIN said USING (conv_id, norm) WHERE level > 0 AND original < turn GROUP BY conv_id, turn, level
), replies AS (
  SELECT conv_id, turn, arg_min(original, level) AS reply_to, CAST(sum(n) AS BIGINT) AS n_quotes FROM best GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, reply_to AS root, 0 AS step FROM replies
  UNION ALL SELECT up.conv_id, up.turn, r.reply_to, step + 1 FROM up JOIN replies r ON r.conv_id = up.conv_id AND r.turn = up.root
), roots AS (
  SELECT conv_id, turn, arg_max(root, step) AS root FROM up GROUP BY conv_id, turn
), linked AS (
  SELECT c.conv_id, c.turn, c.role, reply_to, coalesce(root, c.turn) AS root, coalesce(n_quotes, 0) AS n_quotes,
         CASE WHEN regexp_matches(c.text, '(?m)^(?:[ \t]*>)+')
              THEN regexp_replace(array_to_string(list_filter(string_split(c.text, chr(10)), lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)), '^\s+|\s+$', '', 'g')
              ELSE c.text END AS text
  FROM conversations c LEFT JOIN replies r ON c.conv_id = r.conv_id AND c.turn = r.turn LEFT JOIN roots t ON c.conv_id = t.conv_id AND c.turn = t.turn
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position,
       turn, role, text, reply_to, root, n_quotes
FROM linked
"""


SQL_QUOTES = SQL_OP6.replace("FROM conversations", "FROM quoting").replace(
    "WITH RECURSIVE l AS (",
    """WITH RECURSIVE said AS (SELECT conv_id, turn, min(string_split(text, chr(10))[1]) AS line FROM conversations GROUP BY conv_id, turn),
quoting AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.text IS NOT NULL THEN concat_ws(chr(10), '> ' || a.line, '> > ' || b.line, c.text) END AS text
  FROM conversations c LEFT JOIN said a ON c.conv_id = a.conv_id AND c.turn = a.turn + 1 LEFT JOIN said b ON c.conv_id = b.conv_id AND c.turn = b.turn + 2
), l AS (""",
).replace("said AS (\n  SELECT conv_id, norm", "origins AS (\n  SELECT conv_id, norm").replace("JOIN said USING (conv_id, norm)", "JOIN origins USING (conv_id, norm)")


#: CRC-32 byte by byte, with the table made from its polynomial.
SQL_OP7 = r"""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([CAST(n AS UBIGINT)], list_transform(range(8), lambda z: CAST(0 AS UBIGINT))), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
         xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT))), lambda c, x: xor(c >> 8, crc[CAST((xor(c, x) & 255) AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS text_crc32
  FROM d, steps
), placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM sized
), sharded AS (
  SELECT *, CAST(least(15, (2 * before + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded
"""


SQL_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL)
  WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS HUGEINT) AS length FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), scored AS (
  SELECT item_id, tf.r, CAST(sum(weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * CAST(n AS HUGEINT) * docs) // length)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN d ON d.r = tf.r, totals GROUP BY item_id, tf.r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (r) WHERE score > 0)
WHERE rank <= 10
"""


def sql_op13() -> str:
    """A table of best edits grows by a row of a conversation at a time: for each state the cost in nine digits, then the audit, so that the least string is the least audit of least cost."""
    edit = lambda s, cost, letter: f"(printf('%09d', CAST({s}[1:9] AS INTEGER) + {cost}) || {s}[10:] || '{letter}')"  # noqa: E731
    least = lambda *all_: f"list_min([{', '.join(all_)}])"  # noqa: E731
    two = least("s2", edit("s0", 2, "I"), edit("s1", 2, "I"), edit("s3", 2, "I"))
    free = lambda letter: f"CASE WHEN f NOT IN ('b', 'd') THEN {letter} END"  # noqa: E731
    keep = lambda s, ini: f"CASE WHEN f NOT IN ('b', 'd') AND ini = '{ini}' THEN {edit(s, 'short', 'K')} END"  # noqa: E731
    rerole = lambda s: free(edit(s, "2 + short", "R"))  # noqa: E731
    steps = [
        edit("e0", 3, "D"),
        least(edit("e1", 3, "D"), keep("e0", "s")),
        least(edit("e2", 3, "D"), *[keep(s, "u") for s in ("e0", "e1", "e3")], *map(rerole, ("e0", "e1", "e3"))),
        least(edit("e3", 3, "D"), keep("e2", "a"), rerole("e2")),
    ]
    return rf"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([CAST(n AS UBIGINT)], list_transform(range(8), lambda z: CAST(0 AS UBIGINT))), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS crc),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
crcs AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT))), lambda c, x: xor(c >> 8, crc[CAST((xor(c, x) & 255) AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS k
  FROM named, steps
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crcs WHERE k <> 0
), ordered AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), rows_ AS (
  SELECT *, CASE WHEN f = 't' THEN 1 ELSE 0 END AS short
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS f,
               coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM ordered)
), convs AS (
  SELECT DISTINCT conv_id FROM conversations
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM convs
  UNION ALL
  SELECT conv_id, i, {", ".join(steps)}
  FROM (SELECT conv_id, i, f, short, ini, s0 AS e0, s1 AS e1, e2, {least("s3", edit("e2", 2, "I"))} AS e3
        FROM (SELECT dp.conv_id, r.i, f, short, ini, s0, s1, s3, {two} AS e2 FROM dp JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))
), finished AS (
  SELECT conv_id, {least("s0", "s3", edit(two, 2, "I"))} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), audits AS (
  SELECT conv_id, CAST(best[1:9] AS BIGINT) AS cost, best[10:] AS audit FROM finished
), walk AS (
  SELECT conv_id, audit, 0 AS p, CAST(0 AS BIGINT) AS i, '' AS last, CAST([] AS VARCHAR[]) AS said FROM audits
  UNION ALL
  SELECT conv_id, audit, p + 1, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
         CASE e WHEN 'D' THEN last WHEN 'K' THEN left(role, 1) ELSE CASE WHEN last = 'u' THEN 'a' ELSE 'u' END END,
         CASE e WHEN 'D' THEN said ELSE list_append(said, CASE WHEN e = 'K' THEN role WHEN last = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.conv_id, w.audit, w.p, w.i, w.last, w.said, w.audit[w.p + 1] AS e, r.role, r.text FROM walk w LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 WHERE w.p < length(w.audit))
), told AS (
  SELECT conv_id, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM walk WHERE p = length(audit)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, repaired_sha256
FROM audits a JOIN told t ON a.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, XXH64, zstandard or a fitted model, or make files: tests hold them against plain versions."""
    return {"op4_warc": SQL_OP4, "op5_decontamination": SQL_OP5, "op6_chat": SQL_OP6, "op7_sharding": SQL_OP7, "op11_search": SQL_OP11, "op13_repair": sql_op13(), "chat_quotes": SQL_QUOTES}
