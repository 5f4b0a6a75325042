"""Chat formatting: records of any known layout become canonical turns, and turns one text with a loss mask.

A record is JSON. Its nested field paths are hashed; the hash selects a declarative mapping that reads the turns.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that must not stand in a text: the marks' opening and the control strings of common chat templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"
#: Records of so many bytes are read without a variant where none can hold them (Spark's limit is about four times as much).
LONG = 4 << 20
#: Names of the speakers in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``example`` shows the field paths. ``items`` names a list of turns with its role and text fields; otherwise
    ``fields`` are ``(role, path, *more paths)`` of single turns, whose texts are joined by a blank line."""
    name: str
    example: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, ...], ...] = ()


LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"","content":""}]}', ("messages", "role", "content")),
    Layout("messages_empty", '{"messages":[]}', ("messages", "role", "content")),
    Layout("conversations", '{"conversations":[{"from":"","value":""}]}', ("conversations", "from", "value")),
    Layout("conversation", '{"conversation":[{"role":"","text":""}]}', ("conversation", "role", "text")),
    Layout("instruction", '{"instruction":"","output":""}', fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", '{"instruction":"","input":"","output":""}',
           fields=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout("instruction_system", '{"system":"","instruction":"","output":""}',
           fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_response", '{"prompt":"","response":""}', fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", '{"prompt":"","completion":""}', fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_system", '{"system":"","prompt":"","response":""}',
           fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", '{"question":"","answer":""}', fields=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text, whatever the order of fields and the kinds of values."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.xxhash64(F.regexp_replace(shape, r"\b(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP\w*|DECIMAL\([0-9,]*\))", "*"))


def escaped(text: Column) -> Column:
    """Backslashes doubled, then one backslash after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(layout: Layout, record: Column) -> Column:
    parsed = F.try_parse_json(record)
    if layout.items:
        path, role, text = layout.items
        found = F.try_variant_get(parsed, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(found, lambda t: F.struct(F.coalesce(t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    value = lambda p: F.coalesce(F.try_variant_get(parsed, f"$.{p}", "string"), F.lit(""))
    return F.array(*(F.struct(F.lit(f[0]).alias("role"), F.array_join(F.filter(
        F.array(*(value(p) for p in f[1:])), lambda x: x != "") if len(f) > 2 else F.array(value(f[1])), "\n\n").alias("text"))
        for f in layout.fields))


def _skeleton(record: Column) -> Column:
    """A JSON text without white space: known names with a value are ``<name>``, other strings, numbers and truth values ``<>``."""
    names = sorted({n for x in LAYOUTS for n in (x.items or [p for f in x.fields for p in f[1:]])})
    text = F.regexp_replace(record, r"(?s)\\.", "?")  # what is escaped can't end a string
    text = F.regexp_replace(text, '"(?:(' + "|".join(names) + r')"\s*+:|[^"]*+")', "<$1>")
    text = F.regexp_replace(text, r"\s++", "")
    text = F.regexp_replace(text, r"-?[0-9][0-9.eE+-]*+|\b(?:true|false)\b", "<>")
    return F.regexp_replace(text, r"<(\w++)>(?:<>|null)", "<$1>")


def _long_fits(layout: Layout, skeleton: Column) -> Column:
    """Whether a skeleton has the field paths of a layout (an empty list is never long)."""
    if layout.items:
        path, role, text = layout.items
        turn = rf"\{{(?:<{role}>(?:,<{text}>)?|<{text}>(?:,<{role}>)?)?\}}"
        rest = F.regexp_replace(F.regexp_replace(skeleton, turn, "#"), r"(?<=[\[,])null(?=[,\]])", "#")
        return (F.regexp_replace(rest, "#,(?=#)", "") == f"{{<{path}>[#]}}") & F.contains(skeleton, F.lit(f"<{role}>")) & F.contains(
            skeleton, F.lit(f"<{text}>"))
    fields = sorted(f"<{p}>" for f in layout.fields for p in f[1:])
    return (F.length(skeleton) < 1000) & (F.array_join(F.sort_array(F.split(F.regexp_replace(skeleton, r"^\{|\}$", ""), ",")), ",") == ",".join(
        fields)) & F.startswith(skeleton, F.lit("{")) & F.endswith(skeleton, F.lit("}"))


def _long_turns(layout: Layout, record: Column) -> Column:
    """``_turns`` of a record that no variant can hold; null if it is broken."""
    shape = f"`{layout.items[0]}` array<struct<`{layout.items[1]}`:string,`{layout.items[2]}`:string>>" if layout.items else ", ".join(
        f"`{p}` string" for f in layout.fields for p in f[1:])
    parsed = F.from_json(record, f"{shape}, _broken string", {"columnNameOfCorruptRecord": "_broken", "maxStringLen": str(2 ** 31 - 1)})
    if layout.items:
        path, role, text = layout.items
        turns = F.transform(parsed[path], lambda t: F.struct(
            F.coalesce(t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    else:
        value = lambda p: F.coalesce(parsed[p], F.lit(""))
        turns = F.array(*(F.struct(F.lit(f[0]).alias("role"), F.array_join(F.filter(
            F.array(*(value(p) for p in f[1:])), lambda x: x != "") if len(f) > 2 else F.array(value(f[1])), "\n\n").alias("text"))
            for f in layout.fields))
    return F.when(parsed["_broken"].isNull(), turns)


def _prints(spark: SparkSession) -> list[int]:
    """Fingerprints of the layouts' examples (constants; one row)."""
    return list(spark.range(1).select(*(fingerprint(F.lit(x.example)).alias(f"f{i}") for i, x in enumerate(LAYOUTS))).first())


def canonical_turns(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, layout, turns)`` of JSON records.

    A record of another layout, a broken one and a null have null ``layout`` and ``turns``: none is dropped. A record
    too long for a variant is read by its layout's schema. Null roles and texts are empty. Speaker names of other layouts become user and assistant."""
    prints = _prints(records.sparkSession)
    base = records.select(*keep, F.col(record).alias("_record"), fingerprint(F.col(record)).alias("_print"))
    base = base.withColumn("_long", F.when(
        (F.octet_length("_record") >= LONG) & F.try_parse_json("_record").isNull(), _skeleton(F.col("_record"))))
    lists = [x for x in LAYOUTS if x.name != "messages_empty"]
    base = base.withColumn("_fit", F.when(F.col("_long").isNotNull(), F.coalesce(*(F.when(_long_fits(x, F.col("_long")), F.lit(x.name)) for x in lists))))
    base = base.withColumn("_read", F.coalesce(*(F.when(F.col("_fit") == x.name, _long_turns(x, F.col("_record"))) for x in lists)))
    layout, turns = F.when(F.col("_read").isNotNull(), F.col("_fit")), F.col("_read")
    for x, print_ in reversed(list(zip(LAYOUTS, prints))):
        here = F.col("_print") == F.lit(print_)
        layout = F.when(here, F.lit(x.name)).otherwise(layout)
        turns = F.when(here, _turns(x, F.col("_record"))).otherwise(turns)
    renamed = lambda t: F.struct(F.when(F.col("layout") == "conversations", F.coalesce(
        F.create_map(*[F.lit(s) for kv in ROLES.items() for s in kv])[t["role"]], t["role"])).otherwise(t["role"]).alias("role"),
        t["text"].alias("text"))
    out = base.select(*keep, layout.alias("layout"), turns.alias("turns"))
    return out.select(*keep, "layout", F.transform("turns", renamed).alias("turns"))


def format_turns(turns: Column, learned: tuple[str, ...] = ("assistant",)) -> tuple[Column, Column]:
    """``(formatted text, loss mask)``: the mask has one entry per turn, null unless the turn is learned: where its
    (escaped) text starts, counted from the start of the turn, and how many code points it has."""
    parts = F.transform(turns, lambda t: F.struct(escaped(t["role"]).alias("r"), escaped(t["text"]).alias("t"),
                                                  t["role"].isin(*learned).alias("m")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit(TURN), p["r"], F.lit(TEXT), p["t"], F.lit(END))), "")
    mask = F.transform(parts, lambda p: F.when(p["m"], F.struct(
        (F.lit(len(TURN) + len(TEXT)) + F.char_length(p["r"])).alias("start"), F.char_length(p["t"]).alias("length"))))
    return text, mask


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, escapes undone."""
    pieces = F.split(formatted, r"\Q" + END + r"\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece):
        head = F.substring_index(piece, TEXT, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(TURN) + 1))).alias("role"),
                        unescaped(F.substr(piece, F.char_length(head) + len(TEXT) + 1)).alias("text"))
    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, escapes undone, as one string."""
    pieces = F.split(formatted, r"\Q" + END + r"\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.array_join(F.filter(F.zip_with(pieces, mask, lambda p, m: F.when(
        m.isNotNull(), unescaped(F.substr(p, m["start"] + 1, m["length"])))), lambda x: x.isNotNull()), "")


def format_chats(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, layout, turns, formatted, loss_mask)`` of JSON records; unknown layouts have nulls there."""
    turns = canonical_turns(records, record, keep)
    text, mask = format_turns(F.col("turns"))
    return turns.select(*keep, "layout", "turns", text.alias("formatted"), mask.alias("loss_mask"))


def conversation_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, record)``: one JSON record per conversation, its turns in order (ties by role, then text)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lists = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("content")))).alias("m"))
    return lists.select("conv_id", F.to_json(F.struct(F.transform("m", lambda t: F.struct(
        t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))).alias("record"))


def chat_digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what is read back from formatted texts and masks."""
    read = formatted.select(F.col(key), read_turns(F.col("formatted")).alias("turns"),
                            read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
                            F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(key, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       "formatted_chars")
