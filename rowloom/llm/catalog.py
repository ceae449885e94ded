"""Registered queries of the training-data operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, langid, mainpages, mixing, repair, sequences, simhash, spelling, substrings, tokens, topk, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def held_out(key: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    return langid.fit_languages(learned, "doc_id", "text", "lang")


URL_RULES = [
    ("com/", urlfilter.ALLOW),
    ("example.com/en/", urlfilter.BLOCK),
    ("www.example.com/en/", urlfilter.ALLOW),
    ("net/es/", urlfilter.BLOCK),
    ("net/fr/", urlfilter.BLOCK),
]


@query("op1_url_segmentation")
def url_segmentation(spark, folder):
    return urlfilter.judge_urls(table(spark, folder, "pages"), "page_id", "url", "html", URL_RULES)


@query("op2_simhash_multi_index")
def simhash_multi_index(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op3_token_counts")
def token_counts(spark, folder):
    docs = table(spark, folder, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = tokens.count_tokens(docs, "text", vocabulary(), ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op4_subset_sum_mixing")
def subset_sum_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, "doc_id", "size", "source")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken")
    )


@query("op5_arrow_sequences")
def arrow_sequences(spark, folder):
    return sequences.encode_to_files(table(spark, folder, "documents"), "doc_id", "text", vocabulary())


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityChain:
    """Low quality first, then toxic, learned from the labelled documents that are not held out."""
    marked = labels.where(~held_out()).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit_chain(docs, marked, "doc_id", "text", ["low_quality", "toxic"])


@query("op6_toxicity_chain")
def toxicity_chains(spark, folder):
    docs = table(spark, folder, "documents")
    chain = toxicity_chain(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, chain, "text", ["doc_id"]).withColumnRenamed("flagged", "toxic")


TOPK_SQL = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
               FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op7_maxscore_topk", TOPK_SQL)
def maxscore_topk(spark, folder):
    return topk.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", every=50)


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
    b AS (SELECT row_number() OVER () AS i, item_id, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark),
    patterns AS (
        SELECT DISTINCT i, item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS p
        FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT n FROM patterns),
    starts AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
    hits AS (
        SELECT r, s, q.n, i, item_id FROM starts q JOIN patterns p
        ON p.n = q.n AND p.p = array_to_string(q.w[s : s + q.n - 1], ' ')),
    words AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS word FROM hits) GROUP BY r),
    items AS (
        SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
        FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS name FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query("op8_wu_manber_decontamination", DECONTAMINATION_SQL)
def wu_manber_decontamination(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontaminate.overlaps(docs, "text", items, "item_id", "text", ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


SUBSTRING_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    windows AS (
        SELECT r, s, md5(array_to_string(w[s : s + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
    repeated AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM repeated),
    lost AS (SELECT r, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
           sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ')
                  ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
    FROM d LEFT JOIN lost USING (r)"""


@query("op9_difference_cover_dedup", SUBSTRING_SQL)
def difference_cover_dedup(spark, folder):
    return substrings.remove_repeats(table(spark, folder, "documents"), "doc_id", "text").drop("kept")


@query("op10_language_id")
def language_id(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.withColumn("held_out", held_out())
    return langid.predict_languages(rows, language_model(docs), "text", ["doc_id", "held_out"])


# crc32 bit by bit from a table of 256 remainders; the runs' letters have one or two bytes.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""
_RUN_BYTES = """flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"""
SPELLING_SQL = rf"""
    WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    hashed AS (
        SELECT run, xor(list_reduce({_RUN_BYTES}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
        FROM runs, crc WHERE length(run) >= 5),
    spelled AS (
        SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed),
    words AS MATERIALIZED (SELECT word, count(*) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    cut AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM places),
    pairs AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
        UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
    near AS (
        SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
    formed AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
               CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN near USING (word)),
    paths AS (
        SELECT word, word AS here, 0 AS far FROM formed
        UNION ALL SELECT p.word, f.form, far + 1 FROM paths p JOIN formed f ON p.here = f.word WHERE f.form IS NOT NULL)
    SELECT word, form, (SELECT arg_max(here, far) FROM paths p WHERE p.word = formed.word) AS root, n, n_near, form_n FROM formed"""


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, folder):
    found = spelling.variants(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_page_text")
def page_text(spark, folder):
    return mainpages.extract_main_text(table(spark, folder, "pages"), "html", ["page_id", "url"])


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
REPAIR_SQL = f"""
    WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
    named AS (
        SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name,
               coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations),
    hashed AS (
        SELECT conv_id, turn, r, x, xor(list_reduce(list_transform(string_split(name, ''), lambda c: unicode(c)),
                   lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]), 4294967295), 4294967295) % 20 AS k
        FROM named, crc),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS role, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy,
               CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text
        FROM hashed WHERE k <> 0),
    rows AS MATERIALIZED (
        SELECT conv_id, turn, role, text, left(role, 1) AS letter, rtrim(text, {_BLANKS}) AS bare,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
    marked AS MATERIALIZED (
        SELECT *, CASE WHEN bare = '' THEN 2 WHEN seen > 1 THEN 3 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
               lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate,
               count(*) FILTER (WHERE fault = 1) AS truncated,
               count(*) FILTER (WHERE before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
        FROM marked GROUP BY conv_id),
    -- states: 0 nothing yet, 1 after system, 2 user, 3 assistant; up to two inserts come before a row
    inserts(s, mid, price, edits) AS (
        VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
               (2, 2, 0, ''), (2, 3, 2, 'I'), (2, 2, 4, 'II'), (3, 3, 0, ''), (3, 2, 2, 'I'), (3, 3, 4, 'II')),
    steps(mid, comes, onward) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    moves AS (
        SELECT letter, fault, s, mid AS onward, price + 3 AS price, edits || 'D' AS edits
        FROM inserts, (SELECT DISTINCT letter, fault FROM marked)
        UNION ALL
        SELECT letter, fault, s, onward, price + fault + CASE WHEN comes = letter THEN 0 ELSE 2 END,
               edits || CASE WHEN comes = letter THEN 'K' ELSE 'R' END
        FROM inserts JOIN steps USING (mid), (SELECT DISTINCT letter, fault FROM marked WHERE fault < 2)
        WHERE comes = letter OR comes <> 's'),
    ways AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM counts
        UNION ALL
        SELECT w.conv_id, w.i + 1, m.onward, min({{'cost': CAST(w.best.cost + m.price AS BIGINT), 'audit': w.best.audit || m.edits}})
        FROM ways w JOIN marked r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1
        JOIN moves m ON m.letter = r.letter AND m.fault = r.fault AND m.s = w.s
        GROUP BY w.conv_id, w.i, m.onward),
    found AS (
        SELECT conv_id, min({{'cost': best.cost + [0, 4, 2, 0][s + 1], 'audit': best.audit || ['', 'II', 'I', ''][s + 1]}}) AS best
        FROM ways JOIN counts USING (conv_id) WHERE i = n GROUP BY conv_id
        UNION ALL
        SELECT NULL, min({{'cost': best.cost + [0, 4, 2, 0][s + 1], 'audit': best.audit || ['', 'II', 'I', ''][s + 1]}})
        FROM ways w JOIN counts c ON w.conv_id IS NULL AND c.conv_id IS NULL WHERE i = n HAVING count(*) > 0),
    edits AS (
        SELECT conv_id, p, substr(best.audit, p, 1) AS edit,
               length(replace(substr(best.audit, 1, p), 'I', '')) AS i, length(replace(substr(best.audit, 1, p), 'D', '')) AS q
        FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS p FROM found)),
    kept AS (
        SELECT e.conv_id, p, q, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role,
               max(CASE WHEN q = 1 AND edit = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
        FROM edits e LEFT JOIN marked r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i WHERE edit <> 'D'),
    repaired AS (
        SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                   || ':' || text, chr(10) ORDER BY p) AS lines FROM kept GROUP BY conv_id)
    SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
           coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN found f ON g.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN repaired r ON g.conv_id IS NOT DISTINCT FROM r.conv_id"""


@query("op13_conversation_repair", REPAIR_SQL)
def conversation_repair(spark, folder):
    """Faults, cheapest edits and the digest of the repaired rows of every damaged conversation."""
    given = table(spark, folder, "conversations")
    rows, found = repair.repair(repair.damage(given, "conv_id", "turn", "role", "text"), "conv", "turn", "role", "text")
    result = given.select("conv_id").distinct()
    for part in (repair.turn_gaps(rows), found, repair.repaired_digests(rows, found)):
        result = result.join(part, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # a conversation of which no row is left
    gone = F.col("audit").isNull()
    return result.select(
        "conv_id",
        *[F.when(gone, 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
