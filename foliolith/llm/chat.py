"""Chat formatting: schema fingerprints select declarative mappings into canonical turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Control strings of common chat templates after their first character, < or [; none of
#: these may hold one of the two again, else escaping wouldn't be reversible.
_REST = "(\\|[A-Za-z0-9_]*\\|>|/?s>|/?SYS>>|/?INST\\])"
#: Roles as other layouts name them; names not listed stay.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def escape(text: Column) -> Column:
    """A backslash after the first character of every control string; ``unescape`` reverts it.

    A control string that already holds backslashes there gets one more, so no two texts
    have the same form.
    """
    return F.regexp_replace(text, f"([<\\[])(\\\\*)(?={_REST})", "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)(?={_REST})", "$1$2")


# Fixed mappings: the key-path fingerprint of a record's layout to how its turns are read.
# "turns" names an array and its role and text fields; "pairs" lists (role, path) in order.
MAPPINGS = {
    "messages[].content,messages[].role": {"turns": ("messages", "role", "content")},
    "conversations[].from,conversations[].value": {"turns": ("conversations", "from", "value")},
    "conversation[].content,conversation[].role": {"turns": ("conversation", "role", "content")},
    "turns[].role,turns[].text": {"turns": ("turns", "role", "text")},
    "completion,prompt": {"pairs": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt,response": {"pairs": (("user", ("prompt",)), ("assistant", ("response",)))},
    "prompt,response,system": {"pairs": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "answer,question": {"pairs": (("user", ("question",)), ("assistant", ("answer",)))},
    "input,instruction,output": {"pairs": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "instruction,output": {"pairs": (("user", ("instruction",)), ("assistant", ("output",)))},
}


def key_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON record, comma-joined; null if it isn't an object.

    Read from the record's own variant schema, in which a path is a field name under its
    parents: arrays show as [] and the types of leaves don't count. Layouts nest at most
    one array of flat objects; deeper ones get a path that no mapping has.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    top = F.regexp_extract(shape, "^OBJECT<(.*)>$", 1)
    nested = F.regexp_extract_all(top, F.lit("(\\w+): ARRAY<OBJECT<([^<>]*)>>"), F.lit(0))
    flat = F.regexp_replace(top, "\\w+: ARRAY<OBJECT<[^<>]*>>(, )?", "")
    names = F.regexp_extract_all(flat, F.lit("(\\w+): "), F.lit(1))
    inner = F.flatten(F.transform(nested, lambda x: F.transform(
        F.regexp_extract_all(F.regexp_extract(x, "OBJECT<([^<>]*)>", 1), F.lit("(\\w+): "), F.lit(1)),
        lambda f: F.concat(F.regexp_extract(x, "^(\\w+)", 1), F.lit("[]."), f),
    )))
    return F.when(shape.startswith("OBJECT<"), F.array_join(F.sort_array(F.concat(names, inner)), ","))


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths."""
    return F.xxhash64(key_paths(record))


#: Characters of the longest text that Spark's JSON parser reads.
PARSER_LIMIT = 20_000_000


def _checked(record: Column) -> Column:
    """The record; one that no parser can read for its length, not its form, is an error."""
    lost = (F.length(record) > PARSER_LIMIT) & F.try_parse_json(record).isNull()
    return F.when(lost, F.raise_error(F.lit("a record beyond the limits of the JSON parser, or malformed"))).otherwise(record)


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(role, F.lit(""))), role, F.lit(""))


def _read(rows: Column, role: str, text: str) -> Column:
    return F.transform(rows, lambda t: F.struct(_role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))


_TURN = "array<struct<role:string,text:string>>"


def canonical_turns(record: Column, mappings=MAPPINGS) -> Column:
    """array<struct<role, text>> of a JSON record by the mapping of its fingerprint.

    Null fields are empty texts; empty optional parts (system, input) give no turn or line.
    A record whose layout has no mapping, null or malformed JSON gives null; one of more
    than PARSER_LIMIT characters that can't be parsed stops ``format_records``.
    """
    mark, out = F.col("__fingerprint"), None
    for paths, how in mappings.items():
        if "turns" in how:
            name, role, text = how["turns"]
            rows = F.from_json(record, f"{name} array<struct<`{role}`:string,`{text}`:string>>")[name]
            turns = _read(rows, role, text)
        else:
            cells = []
            for role, fields in how["pairs"]:
                parts = [F.get_json_object(record, f"$.{f}") for f in fields]
                joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")
                cells.append(F.when((F.lit(role) != "system") | (joined != ""), F.struct(F.lit(role).alias("role"), joined.alias("text"))))
            turns = F.array_compact(F.array(*cells))
        hit = mark == F.xxhash64(F.lit(paths))
        out = F.when(hit, turns) if out is None else out.when(hit, turns)
    return out.cast(_TURN)


def format_turns(turns: Column) -> Column:
    """One string: every turn between marks, its role percent-encoded, its text escaped."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"),
    )), "")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as they were."""
    chunks = F.array_remove(F.split(formatted, "<\\|im_end\\|>\n"), "")
    return F.transform(chunks, lambda c: F.struct(
        F.url_decode(F.regexp_extract(c, "^<\\|im_start\\|>([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_replace(c, "^<\\|im_start\\|>[^\n]*\n", "")).alias("text"),
    ))


def loss_text(turns: Column, roles=("assistant",)) -> Column:
    """The text under the loss mask: those of the trained roles, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*roles)), lambda t: t["text"]), "")


def format_records(df: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``df`` (a JSON string column ``record``) with ``fingerprint``, ``turns`` and ``formatted``.

    A narrow projection. Unmapped records keep null turns and formatted, never dropped;
    columns of the added names are replaced.
    """
    return (
        df.withColumn("__fingerprint", fingerprint(_checked(F.col(record))))
        .withColumn("turns", canonical_turns(F.col(record), mappings))
        .withColumn("formatted", format_turns(F.col("turns")))
        .withColumn("fingerprint", F.col("__fingerprint")).drop("__fingerprint")
    )


def _messages(rows: DataFrame) -> DataFrame:
    """(conv_id, messages): the rows of each conversation in order, as in ``records_from_rows``."""
    turn = F.struct(
        F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"),
    )
    messages = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.groupBy("conv_id").agg(messages.alias("messages"))


def format_rows(rows: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """(conv_id, fingerprint, turns, formatted) of each conversation in ``rows``.

    As ``format_records`` on ``records_from_rows``: every record's fingerprint selects its
    mapping, and one without a mapping keeps null turns. But texts are never written as JSON
    and parsed, whose parser ends at 20 million characters of a text and 128 MiB of a record:
    the fingerprint is that of the record with empty leaves and equal messages once, which has
    the same key paths, and the mapping is applied to the typed messages.
    """
    # A text in the place of a text, so that the keys stay.
    leaf = lambda x: F.substring(x, 1, 0)
    bare = F.array_distinct(F.transform("messages", lambda x: F.struct(leaf(x["role"]).alias("role"), leaf(x["content"]).alias("content"))))
    mark, turns = F.col("fingerprint"), F.lit(None).cast(_TURN)
    for paths, how in mappings.items():
        name, role, text = how.get("turns", (None, None, None))
        if name == "messages" and {role, text} <= {"role", "content"}:
            turns = F.when(mark == F.xxhash64(F.lit(paths)), _read(F.col(name), role, text).cast(_TURN)).otherwise(turns)
    out = _messages(rows).withColumn("fingerprint", fingerprint(F.to_json(F.struct(bare.alias("messages"))))).withColumn("turns", turns)
    return out.select("conv_id", "fingerprint", "turns", format_turns(F.col("turns")).alias("formatted"))


def records_from_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation as one JSON record in the messages layout.

    Turns are ordered by turn (null first), then role and text, so repeated rows stay and
    ties have one order. A conversation is one string, so its rows meet in one row by
    nature; conversations are spread by their id. A null conv_id is a conversation of its
    own; null texts and roles are empty.
    """
    return _messages(rows).select("conv_id", F.to_json(F.struct("messages")).alias("record"))
