"""Chat formatting that is proved by reading it back.

A turn is written between control strings, by role.  A deterministic parser
reads the result; if it does not give back the turns exactly, texts that clash
with the control strings are escaped and the check is made again.

    conversation := "<s>" turn* "<end>"
    turn := "[INST] " text " [/INST]"          role user
          | " " text "</s>"                     role assistant
          | "[SYS] " text " [/SYS]"             role system
          | "[ROLE " name "] " text " [/ROLE]"  any other role
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "<end>"
#: role -> (opening, closing)
FORMS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
ESCAPE = "\\"
_CONTROL = re.compile(r"\\|</?s>|<end>|\[/?(?:INST|SYS|ROLE)")
_ESCAPED = re.compile(r"\\(.)", re.S)


class FormatError(ValueError):
    pass


def escape(text: str) -> str:
    """A backslash before every control string and backslash."""
    return _CONTROL.sub(lambda m: ESCAPE + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text


def render(turns: list[tuple[str, str]], safe: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the place of each turn's content in it."""
    parts, at, spans = [BEGIN], len(BEGIN), []
    for (role, text), escaped in zip(turns, safe):
        body = escape(text) if escaped else text
        if role in FORMS:
            head, tail = FORMS[role]
        else:
            name = role.replace("\\", "\\\\").replace("]", "\\]")
            head, tail = OTHER[0] + name + OTHER[1], OTHER[2]
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at = spans[-1][1] + len(tail)
    return "".join([*parts, END]), spans


def _until(text: str, at: int, close: str) -> int:
    """Where the first ``close`` that no backslash stands before begins."""
    where = at
    while True:
        hit = text.find(close, where)
        if hit < 0:
            raise FormatError("a turn does not end")
        back = text.find(ESCAPE, where, hit)
        while 0 <= back < hit:  # skip what is escaped
            where = back + 2
            if where > hit:
                break
            back = text.find(ESCAPE, where, hit)
        if where <= hit:
            return hit


def parse(text: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """Turns of a formatted text, and the place of each content in it."""
    if not text.startswith(BEGIN):
        raise FormatError("no beginning")
    at, turns, spans = len(BEGIN), [], []
    while not (text.startswith(END, at) and at + len(END) == len(text)):
        for role, (head, close) in FORMS.items():
            if text.startswith(head, at):
                begin = at + len(head)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise FormatError("no turn begins here")
            stop = _until(text, at + len(OTHER[0]), OTHER[1])
            role, begin, close = unescape(text[at + len(OTHER[0]):stop]), stop + len(OTHER[1]), OTHER[2]
        end = _until(text, begin, close)
        turns.append((role, unescape(text[begin:end])))
        spans.append((begin, end))
        at = end + len(close)
    return turns, spans


def _reads_back(turns, safe) -> tuple[bool, str, list]:
    text, spans = render(turns, safe)
    try:
        got, found = parse(text)
    except FormatError:
        return False, text, spans
    return got == turns and found == spans, text, spans


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and content places; its parse is ``turns``, always.

    First nothing is escaped; then the turns that do not read back alone; then
    every turn, which the grammar makes unambiguous.
    """
    safe = [False] * len(turns)
    same, text, spans = _reads_back(turns, safe)
    if not same:
        safe = [not _reads_back([turn], [False])[0] for turn in turns]
        same, text, spans = _reads_back(turns, safe)
    if not same:
        same, text, spans = _reads_back(turns, [True] * len(turns))
    if not same:
        raise FormatError("the grammar is ambiguous")
    return text, spans


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of assistant
    contents in it, in code points), n_turns.

    A conversation is one training example and so one row; its turns are put in
    order of turn number, then role, then text (null numbers first), and repeated
    rows are turns of their own.  A null text is empty, a null role is the role
    with the empty name, and null conversation ids form one conversation.  An
    empty table gives no rows; other columns are not read.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    one = (turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                                                                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("one"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
           .select("conv_id", F.transform("all", lambda x: x["role"]).alias("roles"), F.transform("all", lambda x: x["text"]).alias("texts")))
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts, losses, counts = [], [], []
            for roles, bodies in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, places = format_turns(list(zip(roles, bodies)))
                texts.append(text)
                losses.append([{"begin": a, "end": b} for role, (a, b) in zip(roles, places) if role == "assistant"])
                counts.append(len(roles))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(losses, spans), pa.array(counts, pa.int32())],
                                             names=["conv_id", "formatted", "loss", "n_turns"])

    return one.mapInArrow(run, f"conv_id {kind}, formatted string, loss array<struct<begin: int, end: int>>, n_turns int")


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, roles, texts, loss_text, formatted_chars from ``formatted`` rows:
    turns by the parser, loss text from the spans, both unescaped."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            roles, texts, losses, chars = [], [], [], []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, _ = parse(text)
                roles.append([r for r, _ in turns])
                texts.append([t for _, t in turns])
                losses.append("".join(unescape(text[s["begin"]:s["end"]]) for s in loss))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string())), pa.array(losses, pa.string()), pa.array(chars, pa.int64())],
                                             names=["conv_id", "roles", "texts", "loss_text", "formatted_chars"])

    return (conversations.select("conv_id", "formatted", "loss")
            .mapInArrow(run, f"conv_id {kind}, roles array<string>, texts array<string>, loss_text string, formatted_chars long"))
