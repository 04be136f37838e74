"""Registered queries of the operators: each applies one to its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm import chat, exact, jaccard, manifest, mixing, outliers, packing, pieces, substring, suffix, suffix_tree, toxicity, trie
from curate.llm.frames import NO_ID, id_in, id_out, plain, table
from curate.plans.registry import Tables, query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_toxicity")
def op1_toxicity(t: Tables) -> DataFrame:
    model = toxicity.fit(t.documents, t.labels, ~toxicity.held_out())
    scored = toxicity.score_texts(t.documents, model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


@query(
    "op2_mixing",
    """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2 ELSE 3 END AS weight
      FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size::DOUBLE AS cap,
             (sum(source_size::DOUBLE) OVER () - coalesce(sum(3 * source_size::DOUBLE) OVER (ORDER BY 3 * source_size / weight, source
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s),
t AS (SELECT source, source_size,
             CASE WHEN cap <= level * weight THEN cap
                  ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
u AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, target - passes * source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(passes * size + greatest(0, least(size, floor(rest - (used - size)))) AS BIGINT) AS taken FROM u
""",
)
def op2_mixing(t: Tables) -> DataFrame:
    return mixing.mix(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(t: Tables) -> DataFrame:
    return jaccard.similar_groups(t.documents, words=4, percent=85)


@query("op4_substring_dedup")
def op4_substring_dedup(t: Tables) -> DataFrame:
    return substring.remove_repeats(t.documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(t: Tables) -> DataFrame:
    return suffix.remove_repeats(t.documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix_tree")
def op6_suffix_tree(t: Tables) -> DataFrame:
    return suffix_tree.fit_and_score(t.documents)


@query(
    "op7_exact_dedup",
    """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
)
def op7_exact_dedup(t: Tables) -> DataFrame:
    groups = exact.exact_groups(t.documents).withColumn("doc_id", id_in())
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # Rows that repeat id and text are one there, with their number.
    each = groups.filter("digest IS NOT NULL").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    read = each.withColumn("text_sha256", F.col("digest")).select(*columns)
    # Texts told apart by length and prefix alone were not read whole; only their digest column needs it.
    digests = exact.keyed(plain(t.documents)).select("doc_id", "n_bytes", "prefix", F.sha2("text", 256).alias("text_sha256"))
    unread = groups.filter("digest IS NULL").join(digests, ["doc_id", "n_bytes", "prefix"]).select(*columns)
    return read.unionByName(unread).withColumn("doc_id", id_out())


@query("op8_quality_outliers")
def op8_quality_outliers(t: Tables) -> DataFrame:
    return outliers.judge(t.documents).drop("lang", "source")


#: A conversation whose texts are control strings, beside those of the table.
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESCAPED = (
    r"regexp_replace(coalesce({0}, ''), '([<\[]\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', "
    r"'\1\\\2', 'g')"
)


@query(
    "op9_chat_format",
    f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
)
def op9_chat_format(t: Tables) -> DataFrame:
    own = t.spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    rows = t.conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.render(chat.fold_events(chat.from_turns(rows.unionByName(own)))))


@query("op10_packing")
def op10_packing(t: Tables) -> DataFrame:
    return packing.pack(t.documents, TOKENIZER)


@query("op12_sentencepiece")
def op12_sentencepiece(t: Tables) -> DataFrame:
    rows = pieces.encode(t.documents, PIECES, decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: CRC-32 of the decimal form of a number, bit by bit over a table made from its polynomial.
_CRC_TABLE = (
    "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: "
    "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
)
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
    "lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
)


@query(
    "op11_prefix_trie",
    f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS rn FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc),
b AS (SELECT c.conv_id, o.rn AS d, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.rn <= c.h),
k AS (SELECT conv_id, h, (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) AS given FROM c),
r AS (SELECT * FROM b UNION ALL SELECT k.conv_id, given + o.rn - h, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.rn > h),
p AS (SELECT conv_id, d, length(text) AS chars, string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY path, d),
w AS (SELECT left(path, CAST(32 * (d - 1) AS BIGINT)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT left(n.path, CAST(32 * u.i AS BIGINT)) AS path, sum(CASE WHEN w.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
      FROM n LEFT JOIN w ON w.path = n.path, LATERAL (SELECT unnest(range(0, n.d + 1)) AS i) u GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM
      (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(w.n_children, 0) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n q ON n.d > 0 AND q.path = left(n.path, CAST(32 * (n.d - 1) AS BIGINT)) AND q.d = n.d - 1
LEFT JOIN w ON w.path = n.path JOIN a ON a.path = n.path LEFT JOIN e ON e.path = n.path
""",
)
def op11_prefix_trie(t: Tables) -> DataFrame:
    return trie.build(rebuilt(trie.paths(t.conversations)))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Conversation ``c`` opens with the first ``h`` turns of ``c - c % 100``, then goes on with its own after as many."""
    turns = F.when(F.col("conv_id") == NO_ID, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    opening = paths.filter("conv_id % 100 = 0").selectExpr(
        "conv_id AS base", f"substring(path, 1, {5 * trie.WIDTH}) AS base_path", "substring(chars, 1, 20) AS base_chars"
    )
    own = paths.withColumn("h", turns).join(opening, F.expr("base = conv_id - conv_id % 100"), "left")

    def opened(column: str, width: int) -> str:
        return f"concat(coalesce(substring(base_{column}, 1, {width} * h), X''), substring({column}, {width} * h + 1)) AS {column}"

    return table(own.selectExpr("conv_id", opened("path", trie.WIDTH), opened("chars", 4)))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of the trees over ``g, idx, h, cnt``, then the siblings of each node with a parent."""
    return f"""
{name} AS (SELECT g, 0 AS level, idx, h, cnt FROM {leaves}
    UNION ALL SELECT g, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (cnt + 7) // 8 FROM {name} WHERE cnt > 1 GROUP BY g, level, idx // 8, cnt),
{name}_steps AS (SELECT g, level, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
    FROM {name} WHERE cnt > 1 WINDOW w AS (PARTITION BY g, level, idx // 8 ORDER BY idx)),
{name}_fold AS (SELECT g, idx AS leaf_idx, 0 AS level, idx, h, s, '' AS path FROM {leaves}
    UNION ALL SELECT f.g, f.leaf_idx, f.level + 1, f.idx // 8, sha256(bef || f.h || aft), sha256(bef || f.s || aft), path || bef || aft
    FROM {name}_fold f JOIN {name}_steps st ON f.g IS NOT DISTINCT FROM st.g AND f.level = st.level AND f.idx = st.idx)"""


@query(
    "op13_merkle_manifest",
    f"""
WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS cnt,
        {_leaf("text")} AS h, CASE WHEN {_CRC.format("doc_id")} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf("text")} END AS s
    FROM documents, crc),
{_tree_sql("a", "l")},
u AS (SELECT 0 AS g, g AS lang, h, h AS s, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS cnt FROM a WHERE cnt = 1),
{_tree_sql("b", "u")},
r AS (SELECT h AS root FROM b WHERE cnt = 1),
p AS (SELECT l.doc_id, l.h AS leaf, u.h AS subroot, f.s AS h, f.path, u.idx FROM a_fold f
    JOIN l ON f.g IS NOT DISTINCT FROM l.g AND f.leaf_idx = l.idx JOIN u ON f.g IS NOT DISTINCT FROM u.lang
    WHERE f.level = (SELECT max(level) FROM a WHERE a.g IS NOT DISTINCT FROM f.g)),
v AS (SELECT doc_id, leaf, subroot, h, path, 0 AS level, idx FROM p
    UNION ALL SELECT doc_id, leaf, subroot, sha256(bef || h || aft), path || bef || aft, v.level + 1, v.idx // 8
    FROM v JOIN b_steps st ON v.level = st.level AND v.idx = st.idx)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, h AS folded_root, h = root AS verified FROM v, r
WHERE level = (SELECT max(level) FROM b)
""",
)
def op13_merkle_manifest(t: Tables) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.when(chosen, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    rows = manifest.manifest(t.documents, presented={"text": lowered})
    end = manifest.folded(F.col("presented"), F.col("path"))
    found = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), end.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
