"""Prompt tables, batch generation and the tables made from its output."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from curate.functions.text import normalize_instruction
from curate.operators.ordering import seeded_hash


@dataclass(frozen=True)
class PromptTemplate:
    """A prompt text with ``{column}`` places and the schema of the answer it asks for."""

    text: str
    schema: str


TEMPLATES = {
    "summary": PromptTemplate(
        "Summarize the record {id} in one or two sentences.\n\n{body}\n\nAnswer with JSON.",
        "summary string",
    ),
    "retrieval": PromptTemplate(
        "Write one broad and one detailed search query that should find the record {id}.\n\n{body}\n\nAnswer with JSON.",
        "broad_query string, broad_reason string, detail_query string, detail_reason string",
    ),
    "label": PromptTemplate(
        "Decide which label fits the record {id} and explain why.\n\n{body}\n\nAnswer with JSON.",
        "label string, explanation string",
    ),
}


def prompt_template(name: str) -> PromptTemplate:
    if name not in TEMPLATES:
        raise ValueError(f"unknown prompt {name!r}; known: {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def fill_template(text: str, columns: dict[str, Column]) -> Column:
    """Concatenate the literal pieces of a template with columns; a null column gives a null prompt."""
    pieces = []
    for literal, field, _, _ in string.Formatter().parse(text):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(columns[field].cast("string"))
    return F.concat(*pieces)


def render_prompt(
    rows: DataFrame, template: str, id_column: str, body: str, max_len: int | None = None, name: str = "prompt"
) -> DataFrame:
    """Add a prompt from a named template, with the whole body or at most ``max_len`` characters of it."""
    text = F.col(body) if max_len is None else F.substring(body, 1, max_len)
    return rows.withColumn(name, fill_template(prompt_template(template).text, {"id": F.col(id_column), "body": text}))


# Fixed wording of the two task-listing prompts.
TASK_HEADING = "Come up with a series of tasks:\n"
CLASSIFICATION_HEADING = (
    "Come up with a series of classification tasks. "
    "Try to specify the possible output labels when possible.\n"
)


def fewshot_prompt(
    rows: DataFrame, group: str, instruction: str, key: str, n: int, seed: int, classification: bool = False
) -> DataFrame:
    """One prompt per group: ``n`` instructions chosen by seeded hash, numbered, then an open number.

    The rank filter keeps ``n`` candidates per group and task before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(seeded_hash(key, seed), key)
    chosen = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    line = F.concat(F.col("_rn").cast("string"), F.lit(". "), normalize_instruction(instruction))
    grouped = chosen.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn"), line.alias("line")))).alias("_lines")
    )
    heading = CLASSIFICATION_HEADING if classification else TASK_HEADING
    body = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    last = F.concat(F.lit("\n"), (F.size("_lines") + 1).cast("string"), F.lit("."))
    return grouped.select(group, F.concat(F.lit(heading), body, last).alias("prompt"))


Model = Callable[[list], list]


def generate_batch(
    rows: DataFrame,
    prompt: str,
    output: str,
    load_model: Callable[[], Model],
    batch_size: int = 64,
) -> DataFrame:
    """Add ``output``, the model's text for each prompt, and ``<output>_error``, why there is none.

    ``load_model`` runs once per task. A batch that fails, or whose answers are not as many as its
    prompts, is repeated row by row, so that one bad prompt nulls only itself and no answer moves to
    another row. Other columns pass through as Arrow data, untouched.
    """

    def answers(model: Model, prompts: list) -> list[tuple]:
        try:
            found = list(model(prompts))
            if len(found) != len(prompts):
                raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
            return [(answer, None) for answer in found]
        except Exception as error:
            if len(prompts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [answers(model, [p])[0] for p in prompts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            out: list = []
            for start in range(0, batch.num_rows, batch_size):  # only these prompts are Python strings
                out.extend(answers(model, batch.column(prompt).slice(start, batch_size).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(side, pa.string()) for side in (zip(*out) if out else ([], [])))],
                [*batch.schema.names, output, f"{output}_error"],
            )

    schema = StructType(list(rows.schema.fields)).add(output, StringType()).add(f"{output}_error", StringType())
    return rows.mapInArrow(run, schema)


def pairs_from_good_bad(rows: DataFrame, sentence: str, good: str = "good", bad: str = "bad") -> DataFrame:
    """Labelled pairs (sentence, description, 1 or 0) from lists of good and bad descriptions."""
    both = F.array(
        F.struct(F.lit(1).alias("label"), F.col(good).alias("items")),
        F.struct(F.lit(0).alias("label"), F.col(bad).alias("items")),
    )
    sides = rows.select(sentence, F.inline(both))
    return sides.select(sentence, F.explode("items").alias("description"), "label")


def chat_pivot(
    rows: DataFrame, conversation: str, turn: str, role: str, content: str, per_row: int
) -> DataFrame:
    """Turns of a conversation as ordered lists of turn, role and content.

    A row holds the turns of one span of ``per_row`` turn numbers (``part`` is the number of the
    span), so that no list outgrows a task; choose it above the longest conversation to get one row
    each. Turn numbers are kept, so the way back does not depend on it.
    """
    part = F.floor(F.col(turn) / F.lit(per_row)).cast("long")
    turns = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    grouped = rows.groupBy(conversation, part.alias("part")).agg(
        F.array_sort(F.collect_list(turns)).alias("_turns")
    )
    return grouped.select(conversation, "part", F.col("_turns").alias("messages"))


def chat_unpivot(rows: DataFrame, conversation: str, messages: str = "messages") -> DataFrame:
    """One row per message, with the turn number it had."""
    return rows.select(conversation, F.inline(messages))
