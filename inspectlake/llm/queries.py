"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from inspectlake.llm import chat, decontam, hamming, langid, naming, ngram_join, pieces, pii, prefix_trie, sitetree, spelling, toxicity, warc
from inspectlake.llm.naming import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_block_naming",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1(spark, folder):
    return naming.exact_groups(numbered(table(spark, folder, "documents"))).drop("uid")


@query(
    "op3_count_vector_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
      FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
        JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))
    ), reach AS (
      SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
    )
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
    FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """,
)
def op3(spark, folder):
    return ngram_join.near_groups(numbered(table(spark, folder, "documents"))).drop("uid", "key")


@query("op4_byte_network")
def op4(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query("op2_pigeonhole_edits")
def op2(spark, folder):
    return decontam.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_piece_lattice")
def op7(spark, folder):
    return pieces.encoded(table(spark, folder, "documents"))


@query("op5_random_field")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op9_vote_labelers")
def op9(spark, folder):
    return pii.find(table(spark, folder, "documents"))


@query("op6_budget_windows")
def op6(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(rows.unionByName(more)))


@query(
    "op8_salvage_reader",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op8(spark, folder):
    return warc.archived(table(spark, folder, "pages"))


@query("op10_site_style_tree")
def op10(spark, folder):
    return sitetree.extract(table(spark, folder, "pages"))


#: The 256 entries of the table for the checksum of a byte string, and the checksum of ``code`` (bytes in hex).
_CRC_TABLE = """
  SELECT list(e ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS e FROM range(256) r(i)
  )
"""
_CRC = """
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1])))
"""


@query(
    "op13_prefix_suffix_tiles",
    rf"""
    WITH RECURSIVE crc AS ({_CRC_TABLE}),
    runs AS (
      SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS code FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
      ) WHERE length(run) >= 7 GROUP BY ALL
    ), hashed AS (SELECT run, n, {_CRC} AS h FROM runs, crc),
    w AS (
      SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
      ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
    holed AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS star, substr(word, 1, i - 1) || substr(word, i + 1) AS gone FROM spots),
    near AS (
      SELECT a.word, b.word AS other, b.n FROM holed a JOIN holed b ON a.star = b.star AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM holed a JOIN w b ON a.gone = b.word
      UNION SELECT b.word, a.word, a.n FROM holed a JOIN w b ON a.gone = b.word
    ), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other COLLATE "binary") AS other, max(n) AS best_n FROM near GROUP BY word),
    judged AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN other END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
      FROM w LEFT JOIN best USING (word)
    ), chain AS (SELECT word, word AS root FROM w UNION SELECT chain.word, j.form FROM chain JOIN judged j ON j.word = chain.root WHERE j.form IS NOT NULL)
    SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n
    FROM judged j JOIN chain c ON c.word = j.word JOIN judged e ON e.word = c.root AND e.form IS NULL
    """,
)
def op13(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_multi_index_hashing")
def op12(spark, folder):
    return hamming.search(table(spark, folder, "embeddings"), every=20)


@query(
    "op11_turn_matrix_trie",
    f"""
    WITH crc AS ({_CRC_TABLE}),
    t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL
    ), ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, hex(encode(conv_id::VARCHAR)) AS code FROM t),
    c AS (SELECT conv_id, base, {_CRC} % 6 AS h FROM ids, crc),
    r AS (
      SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
    ), s AS (SELECT c.conv_id, coalesce(list(struct_pack(role := r.role, text := r.text) ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
    p AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
    n AS (
      SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN (count(*) - 1) * length(path[d].text) ELSE 0 END AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
      FROM p GROUP BY path, d
    ), k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
    u AS (SELECT path[1:j] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM m) GROUP BY ALL)
    SELECT m.conv_id, m.d AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends_sha256
    FROM m JOIN u USING (path) LEFT JOIN m a ON m.d > 0 AND a.path = m.path[1:m.d - 1]
    """,
)
def op11(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))
