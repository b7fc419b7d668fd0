"""Chat formatting (8): token-level assembly of conversations with reserved ids, loss masks and escapes.

Text form of a conversation, one block per turn::

    ### Role: text </turn>

with a newline after each block and no blank before ``</turn>``. Within a role
or a text a backslash is put before every backslash and before every control
string, so a control string without one is always the template's own.
Token form: the control strings are ids above the vocabulary; roles and texts
are encoded by themselves, so no token crosses a border.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.llm.base import load_tokenizer, slices

#: Control strings in the order of their ids, which follow the vocabulary's last.
CONTROL = ("### ", ": ", "</turn>\n")
#: What is escaped inside roles and texts. ": " ends a role only, and a role escapes every colon.
_TEXT = re.compile(r"\\|### |</turn>")
_ROLE = re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Inverse of ``escape``: each backslash is dropped and what follows it taken as it is."""
    return _ESCAPED.sub(lambda m: m[1], text)


def assemble(roles: list[str], texts: list[str], tokenizer: Any, first_id: int,
             trained: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and loss mask of each turn: open, role, colon, text, close; the mask covers the text of trained roles."""
    pieces = [escape(r, role=True) for r in roles] + [escape(t) for t in texts]
    encoded = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
    for i, role in enumerate(roles):
        segments = [[first_id], encoded[i], [first_id + 1], encoded[len(roles) + i], [first_id + 2]]
        ends = np.cumsum([len(s) for s in segments])
        steps = np.zeros(ends[-1] + 1, dtype=np.int8)
        if role in trained:
            steps[ends[2]] += 1
            steps[ends[3]] -= 1
        yield np.concatenate([np.asarray(s, dtype=np.int32) for s in segments]), np.cumsum(steps)[:-1].astype(np.int8)


def format_turns(turns: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: ``conv_id, turn, ids, loss_mask, first_token``, the place of its ids in its conversation.

    The conversation is the concatenation of its turns' ids by ``turn``; ties
    are ordered by role and text, repeated rows are repeated turns. Null roles
    and texts count as empty; rows with a null ``conv_id`` form one
    conversation; a null ``turn`` comes first. Empty tables give no rows; other columns
    are not read. Turns stay separate rows, so that no conversation has to fit
    into one task; places come from a running sum that spills.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path, plain_specials=True)
        first_id = tokenizer.get_vocab_size(with_added_tokens=True)
        for batch in slices(batches):
            roles, texts = ([t or "" for t in batch.column(i).to_pylist()] for i in (2, 3))
            made = list(assemble(roles, texts, tokenizer, first_id, trained))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(range(len(made)), pa.int64()),
                batch.column(4), pa.array([len(i) for i, _ in made], pa.int64()),
                pa.array([i for i, _ in made], pa.list_(pa.int32())),
                pa.array([m for _, m in made], pa.list_(pa.int8())),
            ], names=["conv_id", "turn", "_n", "_tie", "_len", "ids", "loss_mask"])

    kinds = dict(turns.dtypes)
    tie = F.xxhash64("role", "text")
    rows = turns.select("conv_id", "turn", "role", "text", tie.alias("_tie")).mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, _n long, _tie long, _len long, "
             "ids array<int>, loss_mask array<tinyint>").drop("_n")
    before = Window.partitionBy("conv_id").orderBy("turn", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_token", F.coalesce(F.sum("_len").over(before), F.lit(0))).drop("_tie", "_len")


def read_back(ids: np.ndarray, mask: np.ndarray, tokenizer: Any, first_id: int) -> tuple[str, str, str, str]:
    """Role, text, text under the mask, and text form of one turn, from its ids and mask alone."""
    control = np.flatnonzero(ids >= first_id)
    (begin, middle, end), n = control, len(ids)
    if [int(x) - first_id for x in ids[control]] != [0, 1, 2] or begin != 0 or end != n - 1:
        raise ValueError("not a turn of this template")
    role, text = tokenizer.decode_batch(
        [ids[1:middle].tolist(), ids[middle + 1:end].tolist()], skip_special_tokens=False)
    loss = tokenizer.decode(ids[mask == 1].tolist(), skip_special_tokens=False) if mask.any() else ""
    return unescape(role), unescape(text), unescape(loss), CONTROL[0] + role + CONTROL[1] + text + CONTROL[2]


def digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation, read back from ``format_turns``: counts and SHA-256 of its turns and loss text.

    Conversations are sorted, not gathered: a task keeps the running digests of
    one conversation at a time, however long it is.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path, plain_specials=True)
        first_id = tokenizer.get_vocab_size(with_added_tokens=True)
        conv: Any = None
        state: list[Any] = []
        id_type = None

        def row() -> list[Any]:
            return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in slices(batches):
            done = []
            id_type = batch.schema.field(0).type
            for key, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not state or key != conv:
                    if state:
                        done.append(row())
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, form = read_back(np.asarray(ids), np.asarray(mask), tokenizer, first_id)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(form)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 6, [id_type, *types])], names=fields)
        if state:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row(), [id_type, *types])], names=fields)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "first_token")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


def oracle(extra: str) -> str:
    """DuckDB SQL for the digests of ``conversations`` and of two more turns whose text is ``extra``."""
    quoted = extra.replace("'", "''")
    template = sum(map(len, CONTROL))
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{quoted}' UNION ALL SELECT -7, 1, 'assistant', '{quoted}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({template} + length(regexp_replace(role, '(\\|### |</turn>|:)', '\\\1', 'g'))
      + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
