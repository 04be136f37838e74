"""Queries on model output, prompts and chat tables."""

from pyspark.sql import functions as F

from curate.functions import records
from curate.operators import prompts
from curate.plans.registry import query

# Answers of a model, built around the documents: fenced JSON, a broken fence followed by a good
# one, bare braces, and text without JSON, by language.
REPLIES = """WITH r AS (SELECT doc_id, lang, '{"id": ' || doc_id || ', "lang": "' || lang || '"}' AS obj, text FROM documents),
                  m AS (SELECT doc_id, CASE lang
                          WHEN 'en' THEN text || chr(10) || '```json' || chr(10) || obj || chr(10) || '```'
                          WHEN 'fr' THEN '```json' || chr(10) || '{"id": ' || chr(10) || '```' || text || obj
                          WHEN 'de' THEN 'Answer: ' || obj || text
                          ELSE text END AS reply FROM r) """


def replies(t):
    obj = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang", F.lit('"}'))
    reply = (
        F.when(F.col("lang") == "en", F.concat("text", F.lit("\n```json\n"), obj, F.lit("\n```")))
        .when(F.col("lang") == "fr", F.concat(F.lit('```json\n{"id": \n```'), "text", obj))
        .when(F.col("lang") == "de", F.concat(F.lit("Answer: "), obj, "text"))
        .otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", reply.alias("reply"))


@query(
    "extract_json_block",
    REPLIES
    + r"""SELECT doc_id, CASE
            WHEN json_valid(regexp_extract(reply, '(?s)```json\n(.*?)```', 1)) THEN regexp_extract(reply, '(?s)```json\n(.*?)```', 1)
            WHEN json_valid(regexp_extract(reply, '(?s)(\{[^}]*\})', 1)) THEN regexp_extract(reply, '(?s)(\{[^}]*\})', 1)
          END AS block FROM m""",
)
def extract_json_block(t):
    return replies(t).select("doc_id", records.extract_json_block("reply").alias("block"))


def damaged_props(t):
    broken = F.regexp_replace("props", r"\}$", "")
    return t.events.select("event_id", F.when(F.col("event_type") == "error", broken).otherwise(F.col("props")).alias("props"))


DAMAGED = """WITH p AS (SELECT event_id, CASE WHEN event_type = 'error' THEN regexp_replace(props, '\\}$', '') ELSE props END AS props
                        FROM events) """


@query(
    "parse_json_record",
    DAMAGED
    + """SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
           json_valid(props) AS parsed_into_json FROM p""",
)
def parse_json_record(t):
    return records.parse_json_record(damaged_props(t), "props", "k int").drop("props")


@query(
    "parse_success_rate",
    DAMAGED
    + """, g AS (SELECT CASE WHEN event_id IN (SELECT event_id FROM events WHERE event_type = 'signup') THEN NULL ELSE props END AS props
                 FROM p)
         SELECT coalesce(json_valid(props), false) AS parsed_into_json, count(*) AS n, count(*) - count(props) AS n_null
         FROM g GROUP BY 1""",
)
def parse_success_rate(t):
    # Some generations are missing altogether.
    missing = t.events.filter("event_type = 'signup'").select("event_id", F.lit(True).alias("missing"))
    rows = damaged_props(t).join(missing, "event_id", "left")
    rows = rows.withColumn("props", F.when(F.col("missing").isNull(), F.col("props")))
    return records.parse_success_rate(records.parse_json_record(rows, "props", "k int"), "props")


@query(
    "validate_record",
    """WITH r AS (SELECT doc_id, text AS description, nullif(lang, 'es') AS category, string_split(source, 'c') AS tags FROM documents)
       SELECT doc_id, concat_ws(',',
         CASE WHEN category IS NULL THEN 'category:missing' END,
         CASE WHEN category NOT IN ('en', 'de') THEN 'category:not_allowed' END,
         CASE WHEN length(description) < 50 THEN 'description:too_short' END,
         CASE WHEN length(description) > 1000 THEN 'description:too_long' END,
         CASE WHEN len(tags) > 3 THEN 'tags:too_many_items' END,
         CASE WHEN len(list_filter(tags, lambda x: length(x) < 2)) > 0 THEN 'tags:item_too_short' END) AS violations FROM r""",
)
def validate_record(t):
    rows = t.documents.select(
        "doc_id",
        F.col("text").alias("description"),
        F.nullif("lang", F.lit("es")).alias("category"),
        F.split("source", "c").alias("tags"),
    )
    checked = records.validate_record(
        rows,
        [
            records.required("category"),
            records.one_of("category", ["en", "de"]),
            records.min_length("description", 50),
            records.max_length("description", 1000),
            records.max_items("tags", 3),
            records.each_min_length("tags", 2),
        ],
    )
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"))


# Lines of at least three words become annotations; the others stay malformed.
ANNOTATED = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
                     a AS (SELECT doc_id, regexp_extract(line, '^([^ ]+) ([^ ]+) (.*)$', ['e', 'c', 'd']) AS m FROM l
                           WHERE regexp_matches(line, '^([^ ]+) ([^ ]+) (.*)$')) """


def annotated_documents(t):
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.regexp_replace(x, r"^([^ ]+) ([^ ]+) (.*)$", "$1 -|- $2 -|- $3"),
    )
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("generated"))


@query(
    "parse_delimited_annotations",
    ANNOTATED + "SELECT doc_id, trim(m.e) AS entity, trim(m.c) AS concept, md5(trim(m.d)) AS description FROM a",
)
def parse_delimited_annotations(t):
    rows = records.parse_delimited_annotations(annotated_documents(t), "generated")
    return rows.withColumn("description", F.md5("description"))


@query(
    "build_messages",
    """SELECT doc_id, to_json([{'role': 'system', 'content': 'You label documents.'},
         {'role': 'user', 'content': 'Label document ' || doc_id || ' from ' || source},
         {'role': 'assistant', 'content': to_json({'lang': lang, 'n_chars': n_chars})::VARCHAR}])::VARCHAR AS messages FROM documents""",
)
def build_messages(t):
    prompt = F.concat(F.lit("Label document "), F.col("doc_id").cast("string"), F.lit(" from "), "source")
    answer = F.to_json(F.struct("lang", "n_chars"))
    chat = records.build_messages(prompt, answer, "You label documents.")
    return t.documents.select("doc_id", F.to_json(chat).alias("messages"))


@query(
    "render_prompt",
    """SELECT doc_id, md5('Summarize the record ' || doc_id || ' in one or two sentences.' || chr(10) || chr(10)
         || substr(text, 1, 8000) || chr(10) || chr(10) || 'Answer with JSON.') AS prompt FROM documents""",
)
def render_prompt(t):
    # The length limit of the model's prompt is part of this operator.
    rows = prompts.render_prompt(t.documents, "summary", "doc_id", "text", max_len=8000)
    return rows.select("doc_id", F.md5("prompt").alias("prompt"))


@query(
    "fewshot_prompt",
    r"""WITH c AS (SELECT role, text, conv_id || '-' || turn AS key FROM conversations),
             r AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY md5('42:' || key), key) AS rn,
                     rtrim(trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' '), ':') AS line FROM c)
        SELECT role, 'Come up with a series of tasks:' || chr(10) || string_agg(rn || '. ' || line, chr(10) ORDER BY rn)
          || chr(10) || (count(*) + 1) || '.' AS prompt
        FROM r WHERE rn <= 8 GROUP BY role""",
)
def fewshot_prompt(t):
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = t.conversations.select("role", "text", key.alias("key"))
    return prompts.fewshot_prompt(rows, "role", "text", "key", 8, 42)


def load_stub_model():
    """A stand-in for a text model: it answers with length and first word and rejects short prompts."""

    def answer(prompts):
        if any(len(p) < 100 for p in prompts):
            raise ValueError("prompt too short")
        return [f"{len(p)} {p.split(' ')[0]}" for p in prompts]

    return answer


def load_echo_model():
    return lambda prompts: [f"<{p}>" for p in prompts]


@query(
    "generate_batch",
    """SELECT doc_id, CASE WHEN length(text) >= 100 THEN length(text) || ' ' || string_split(text, ' ')[1] END AS answer,
         CASE WHEN length(text) >= 100 THEN '<' || length(text) || ' ' || string_split(text, ' ')[1] || '>' END AS refined
       FROM documents""",
)
def generate_batch(t):
    first = prompts.generate_batch(t.documents.select("doc_id", "text"), "text", "answer", load_stub_model)
    # The answer of one stage is the prompt of the next; a null prompt fails and stays null.
    second = prompts.generate_batch(first.select("doc_id", "answer"), "answer", "refined", load_echo_model)
    return second.select("doc_id", "answer", F.when(F.col("answer").isNotNull(), F.col("refined")).alias("refined"))


def load_forgetful_model():
    """A stand-in that gives no answer to prompts of even length, so its answers are too few."""
    return lambda prompts: [str(len(p)) for p in prompts if len(p) % 2]


@query(
    "generate_batch_errors",
    """SELECT doc_id, CASE WHEN length(text) % 2 = 1 THEN length(text)::VARCHAR END AS answer,
         CASE WHEN length(text) % 2 = 0 THEN 'ValueError: 0 answers to 1 prompts' END AS answer_error FROM documents""",
)
def generate_batch_errors(t):
    rows = t.documents.select("doc_id", "text")
    return prompts.generate_batch(rows, "text", "answer", load_forgetful_model, batch_size=16).drop("text")


@query(
    "pairs_from_good_bad",
    """WITH g AS (SELECT doc_id, lang AS sentence, string_split(text, chr(10)) AS lines FROM documents)
       SELECT sentence, md5(unnest(list_filter(lines, lambda x: length(x) > 60))) AS description, 1 AS label FROM g
       UNION ALL
       SELECT sentence, md5(unnest(list_filter(lines, lambda x: length(x) <= 60))), 0 FROM g""",
)
def pairs_from_good_bad(t):
    lines = F.split("text", "\n")
    rows = t.documents.select(
        F.col("lang").alias("sentence"),
        F.filter(lines, lambda x: F.length(x) > 60).alias("good"),
        F.filter(lines, lambda x: F.length(x) <= 60).alias("bad"),
    )
    return prompts.pairs_from_good_bad(rows, "sentence").withColumn("description", F.md5("description"))


CHATS = """SELECT conv_id, CAST(floor(turn / {0}) AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS turns,
         string_agg(role, '>' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS digest
       FROM conversations GROUP BY conv_id, 2"""


@query(
    "chat_pivot",
    CHATS.format(1000),
)
def chat_pivot(t):
    return chat_digests(t, 1000)


@query("chat_pivot_parts", CHATS.format(3))
def chat_pivot_parts(t):
    return chat_digests(t, 3)


def chat_digests(t, per_row):
    chats = prompts.chat_pivot(t.conversations, "conv_id", "turn", "role", "text", per_row=per_row)
    return chats.select(
        "conv_id",
        "part",
        F.size("messages").alias("turns"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"),
        F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("digest"),
    )


@query("chat_unpivot", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def chat_unpivot(t):
    # Spans of three turns, so that most conversations have several rows on the way.
    chats = prompts.chat_pivot(t.conversations, "conv_id", "turn", "role", "text", per_row=3)
    return prompts.chat_unpivot(chats, "conv_id").select("conv_id", "turn", "role", F.md5("content").alias("digest"))
