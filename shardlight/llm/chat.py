"""Chat formatting: a finite-state machine over roles checks turn order, a declarative template gives the text.

Each conversation is read in turn order. The machine starts in ``start``; every role moves it along
``transitions`` or is an error, and it must end in an accepting state. A valid conversation gives one segment per
piece of the template (opening, body, closing), each with its loss flag; an invalid one gives a single row with
the position and kind of its first error and no text; the position is -1 where there is none.

Defined cases, as errors at the first turn they touch: a null turn ``null_turn``, a repeated turn number (also
repeated rows) ``repeated_turn``, a role that is null or not in the template ``unknown_role``, a null text
``null_text``, a move that the machine doesn't have ``bad_order``, an end outside the accepting states
``unfinished``, at the position after the last turn. Empty texts are legal and give an empty segment. Rows with a
null ``conv_id`` belong to no conversation and are left out. Other columns aren't read. An empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import only


@dataclass(frozen=True)
class Template:
    """``pieces``: for each role (text, loss) pairs, where the text ``{text}`` stands for the turn's own."""

    pieces: dict[str, list[tuple[str, bool]]]
    transitions: dict[tuple[str, str], str]
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    states: tuple[str, ...] = field(default=())


#: A system turn may come first; user and assistant alternate, the assistant is last. Loss is on what it says and its end mark.
CHATML = Template(
    pieces={
        "system": [("<|im_start|>system\n", False), ("{text}", False), ("<|im_end|>\n", False)],
        "user": [("<|im_start|>user\n", False), ("{text}", False), ("<|im_end|>\n", False)],
        "assistant": [("<|im_start|>assistant\n", False), ("{text}", True), ("<|im_end|>", True), ("\n", False)],
    },
    transitions={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)


def _machine(turns: Column, template: Template) -> Column:
    """Folds the sorted turns to (state, position, first error, its position)."""
    edges = F.create_map(*[x for (a, role), b in template.transitions.items() for x in (F.lit(f"{a}\t{role}"), F.lit(b))])
    known = F.array(*[F.lit(r) for r in template.pieces])

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(edges, F.concat(acc["state"], F.lit("\t"), F.coalesce(t["role"], F.lit(""))))
        error = (
            F.when(acc["error"].isNotNull(), acc["error"])
            .when(t["turn"].isNull(), "null_turn")
            .when(t["turn"].eqNullSafe(acc["turn"]), "repeated_turn")
            .when(t["role"].isNull() | ~F.array_contains(known, F.coalesce(t["role"], F.lit(""))), "unknown_role")
            .when(t["text"].isNull(), "null_text")
            .when(to.isNull(), "bad_order")
        )
        at = F.when(acc["error"].isNotNull(), acc["at"]).when(error.isNotNull(), acc["n"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["n"] + 1).alias("n"), t["turn"].cast("long").alias("turn"), error.alias("error"), at.alias("at"))

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(turns, zero, step)


def _segments(t: Column, template: Template) -> Column:
    """The segments of one turn as an array of (role, text, loss)."""
    out = None
    for role, pieces in template.pieces.items():
        own = F.array(*[F.struct(F.lit(role).alias("role"), (t["text"] if p == "{text}" else F.lit(p)).alias("text"), F.lit(loss).alias("loss")) for p, loss in pieces])
        out = F.when(t["role"] == role, own) if out is None else out.when(t["role"] == role, own)
    return out


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Rows (conv_id, valid, error, error_at, segment, role, text, loss); one shuffle, on ``conv_id``."""
    chats = (
        only(turns, "conv_id", "turn", "role", "text")
        .where("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .withColumn("end", _machine(F.col("turns"), template))
    )
    error = F.coalesce(F.col("end.error"), F.when(~F.col("end.state").isin(*template.accepting), F.lit("unfinished")))
    at = F.coalesce(F.col("end.at"), F.when(error.isNotNull(), F.col("end.n")), F.lit(-1))
    chats = chats.select("conv_id", "turns", error.alias("error"), at.cast("int").alias("error_at"))
    # one branch without text stands for an invalid conversation, so that it keeps a row
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("loss")))
    made = F.when(F.col("error").isNull(), F.flatten(F.transform("turns", lambda t: _segments(t, template)))).otherwise(nothing)
    return chats.select("conv_id", F.col("error").isNull().alias("valid"), "error", "error_at", F.posexplode(made).alias("segment", "piece")).select(
        "conv_id", "valid", "error", "error_at", "segment", F.col("piece.role").alias("role"), F.col("piece.text").alias("text"), F.col("piece.loss").alias("loss")
    )


#: The same over the table ``conversations`` for CHATML: ranks of turns, then the first error, then the pieces.
SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER w - 1 AS n, lag(turn) OVER w AS before, lag(role) OVER w AS prior
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), e AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'null_turn' WHEN n > 0 AND turn IS NOT DISTINCT FROM before THEN 'repeated_turn'
    WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'unknown_role' WHEN text IS NULL THEN 'null_text'
    WHEN NOT ((n = 0 AND role IN ('system', 'user')) OR (n > 0 AND ((prior = 'system' AND role = 'user') OR (prior = 'user' AND role = 'assistant') OR (prior = 'assistant' AND role = 'user')))) THEN 'bad_order' END AS err
  FROM t
), c AS (
  SELECT conv_id, arg_min(err, n) FILTER (err IS NOT NULL) AS err, min(n) FILTER (err IS NOT NULL) AS err_at, max(n) + 1 AS size, arg_max(role, n) AS final FROM e GROUP BY conv_id
), v AS (
  SELECT conv_id, coalesce(err, CASE WHEN final <> 'assistant' THEN 'unfinished' END) AS error,
         CAST(coalesce(err_at, CASE WHEN final <> 'assistant' THEN size END, -1) AS INTEGER) AS error_at FROM c
), p AS (
  SELECT * FROM (VALUES ('system', 0, '<|im_start|>system' || chr(10), false), ('system', 1, NULL, false), ('system', 2, '<|im_end|>' || chr(10), false),
    ('user', 0, '<|im_start|>user' || chr(10), false), ('user', 1, NULL, false), ('user', 2, '<|im_end|>' || chr(10), false),
    ('assistant', 0, '<|im_start|>assistant' || chr(10), false), ('assistant', 1, NULL, true), ('assistant', 2, '<|im_end|>', true), ('assistant', 3, chr(10), false)) AS p(role, k, piece, loss)
)
SELECT v.conv_id, true AS valid, v.error, v.error_at, CAST(row_number() OVER (PARTITION BY v.conv_id ORDER BY e.n, p.k) - 1 AS INTEGER) AS segment,
       e.role, coalesce(p.piece, e.text) AS text, p.loss
FROM v JOIN e ON v.conv_id = e.conv_id JOIN p ON p.role = e.role WHERE v.error IS NULL
UNION ALL
SELECT conv_id, false, error, error_at, 0, NULL, NULL, NULL FROM v WHERE error IS NOT NULL
"""
