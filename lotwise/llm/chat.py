"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns; a reversible template marks them.

``canonical_turns`` takes tables of different layouts. The fingerprint of a layout is a hash over its sorted nested field
paths; a registry maps fingerprints to declarations (which path is the list of turns, which fields are role and text, which
columns are which role). For JSON records the paths are found per record, so one table may mix layouts; ``table_turns``
fingerprints the schema of a table that has one turn per row.

``format_turns`` renders a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts are
escaped: a backslash goes before every ``<|`` and every backslash, so that ``<|`` after an even number of backslashes is always
the template's own, and reading back is exact. A line break in a role is written as a backslash and ``n``.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """How one layout's records become turns.

    ``turns``: path of a list of turns with ``role`` and ``text`` fields inside; or ``columns``: (role, [paths]) in order, the
    texts of several paths joined by a blank line, empty ones left out; or ``row``: the columns of conversation and place, of a
    layout with one turn per row. ``roles`` renames role values.
    """

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    columns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.turns:
            return [self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        if self.row:
            return [*self.row, self.role, self.text]
        return [p for _, ps in self.columns for p in ps]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted({*paths})).encode()).hexdigest()[:16]


_SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS = [
    Mapping("messages", turns="messages"),
    Mapping("conversations", turns="conversations", role="from", text="value", roles=_SHARED_ROLES),
    Mapping("turns", turns="turns", role="role", text="text", roles=_SHARED_ROLES),
    Mapping("dialog", turns="dialog", role="speaker", text="text", roles=_SHARED_ROLES),
    Mapping("prompt_response", columns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", columns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt_response", columns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", columns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction_output", columns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input_output", columns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
]
REGISTRY = {fingerprint(m.paths()): m for m in MAPPINGS}
#: Layouts of whole tables with one turn per row; told by the table's schema.
TABLE_MAPPINGS = [
    Mapping("turn_rows", row=("conv_id", "turn"), text="text"),
    Mapping("message_rows", row=("conversation_id", "message_index"), text="content", roles=_SHARED_ROLES),
]
TABLE_REGISTRY = {fingerprint(m.paths()): m for m in TABLE_MAPPINGS}
#: Fields that say nothing of the layout.
IGNORED = {"id", "source", "lang", "dataset", "meta", "metadata", "score"}


def nested_paths(value, at: str = "") -> set[str]:
    """Paths of a record's fields; ``[]`` stands for a list's elements."""
    if isinstance(value, dict):
        return set().union(*[{f"{at}{k}"} | nested_paths(v, f"{at}{k}.") for k, v in value.items() if at or k not in IGNORED])
    if isinstance(value, list):
        return set().union(*[nested_paths(v, f"{at.removesuffix('.')}[].") for v in value])
    return set()


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of a table's fields, written as ``nested_paths`` writes a record's."""
    if isinstance(kind, T.StructType):
        return set().union(*[{f"{at}{f.name}"} | schema_paths(f.dataType, f"{at}{f.name}.") for f in kind if at or f.name not in IGNORED])
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at.removesuffix('.')}[].")
    return set()


def table_turns(table: DataFrame) -> DataFrame:
    """conv_id, layout, turn, role, text of a table with one turn per row, by the mapping of its schema's fingerprint.

    A table of no known layout is refused, so that nothing is read by the wrong columns. Nulls stay and rows stay one by one.
    """
    paths = schema_paths(table.schema)
    mapping = TABLE_REGISTRY.get(fingerprint(paths))
    if not mapping:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    role = F.col(mapping.role)
    for was, now in mapping.roles.items():
        role = F.when(F.col(mapping.role) == was, now).otherwise(role)
    conv, turn = mapping.row
    return table.select(F.col(conv).alias("conv_id"), F.lit(mapping.name).alias("layout"), F.col(turn).alias("turn"), role.alias("role"), F.col(mapping.text).alias("text"))


def record_turns(record) -> tuple[str, list[dict]]:
    """The layout's name (or 'unknown') and the turns of one record."""
    if not isinstance(record, dict):
        return "unknown", []
    mapping = REGISTRY.get(fingerprint(nested_paths(record)))
    if not mapping:
        return "unknown", []
    say = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if mapping.turns:
        turns = [(say(t.get(mapping.role)), say(t.get(mapping.text))) for t in record[mapping.turns] or [] if isinstance(t, dict)]
    else:
        turns = [(role, "\n\n".join(x for p in paths if (x := say(record.get(p))))) for role, paths in mapping.columns]
        turns = [t for t in turns if t[1] or t[0] != "system"]
    return mapping.name, [{"turn": i, "role": mapping.roles.get(r, r), "text": t} for i, (r, t) in enumerate(turns)]


def canonical_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id_col``, layout, turn, role, text from JSON records of mixed layouts.

    A record of no known layout, null, empty or no JSON gives one row with layout 'unknown' and null turn, role and text, so
    that nothing is lost unseen. Null texts are empty. Repeated rows are answered one by one. Other columns are ignored.
    """
    schema = T.StructType([records.schema[id_col], T.StructField("layout", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def convert(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for key, said in zip(pdf[id_col], pdf[json_col], strict=True):
                try:
                    layout, turns = record_turns(json.loads(said) if said else None)
                except ValueError:
                    layout, turns = "unknown", []
                rows += [(key, layout, t["turn"], t["role"], t["text"]) for t in turns] or [(key, layout, None, None, None)]
            frame = pd.DataFrame(rows, columns=[f.name for f in schema])
            yield frame.astype({"turn": "Int64"})

    return records.select(id_col, json_col).mapInPandas(convert, schema)


_SPECIAL = re.compile(r"\\|<\|")
_ESCAPED = re.compile(r"\\(\\|<\||n)")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(said: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(said):
        if not said.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = said.index("\n", at)
        close = _own_end(said, line + 1)
        turns.append((unescape(said[at + len(START) : line]), unescape(said[line + 1 : close]), line + 1, close))
        at = close + len(END) + 1
    return turns


def _own_end(said: str, at: int) -> int:
    """The first end mark after an even number of backslashes; inside texts they are odd."""
    while True:
        at = said.index(END, at)
        back = at
        while back and said[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_end: one formatted piece per turn; a conversation is its pieces in
    order of turn, one after another. ``loss_start`` and ``loss_end`` bound the assistant's (escaped) text in code points;
    null for other roles.

    Null texts and roles are empty. Ties of turn are ordered by role and text.
    Null conv_ids make a conversation of their own. Repeated rows stay. Other columns are ignored; no rows in, none out.
    """

    def convert(batch) -> dict:
        out = {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": [], "formatted": [], "loss_start": [], "loss_end": []}
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            role, text = role or "", text or ""
            said, masked = render(role, text), role == "assistant"
            begin = len(START) + len(escape_role(role)) + 1
            for name, value in (("role", role), ("formatted", said), ("loss_start", begin if masked else None), ("loss_end", len(said) - len(END) - 1 if masked else None)):
                out[name].append(value)
        return out

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return map_arrow(turns.select(*columns), convert, "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, read from its pieces alone.

    Pieces are sorted within partitions and streamed: a task holds one digest at a time, so a conversation may have any
    number of turns.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def convert(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_DIGEST)
        none = object()
        key, state = none, None
        for batch in batches:
            rows = []
            for conv, said, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if conv != key:
                    if key is not none:
                        rows.append(_digest(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(said):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(said[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(said)
            yield told(rows)
        if key is not none:
            yield told([_digest(key, state)])

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").mapInArrow(convert, schema)


_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digest(key, state) -> tuple:
    return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
