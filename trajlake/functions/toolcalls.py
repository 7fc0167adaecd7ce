"""Tool calls inside assistant text: strict parse, near misses and lenient repair."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.text import attempted, strip_space

# Call markers, field patterns and the escapes known to JSON strings.
BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
COMMAND_FIELD = r'(?s)"command"\s*:\s*"(.*)"\s*[,}]'
NAME_FIELD = r'"name"\s*:\s*"([^"]*)"'
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f"}
BASH = "bash"
MISSING_COMMAND = "Missing 'command' argument in bash tool call."
UNKNOWN_TOOL = "Unknown tool '%s'. Only 'bash' is available."

CALL = "struct<name:string,command:string>"


def closed_blocks(text: Column) -> Column:
    """Stripped payloads of all closed call blocks; an unclosed block is left out."""
    found = F.when(attempted(text), F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), strip_space)


def _bracketed(text: Column) -> Column:
    """Text between brackets and before a zero: what follows a JSON value there breaks the syntax or shifts the zero."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))


def _alone(whole: Column) -> Column:
    """The one value of a ``_bracketed`` text, null if there is none or something else besides."""
    one = (F.try_variant_get(whole, "$[1]", "int") == 0) & F.try_variant_get(whole, "$[2]", "variant").isNull()
    return F.when(one, F.try_variant_get(whole, "$[0]", "variant"))


def parsed(text: Column) -> Column:
    """The JSON value of a text as a variant; null if the text is not one JSON value and nothing else."""
    return parsed_all(F.array(text))[0]


def parsed_all(texts: Column) -> Column:
    """``parsed`` of an array of texts. Arrays in between hold each text's value, which lambdas would work out again."""
    return F.transform(F.transform(texts, _bracketed), _alone)


def _field(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _text(value: Column) -> Column:
    """Text of a JSON string, null for any other value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _command(arguments: Column) -> Column:
    """Command of a call with decoded arguments: text as it is, other values as compact JSON, '' for empty ones."""
    given = _field(F.when(_is_object(arguments), arguments), "command")
    shown = F.to_json(given)
    return F.coalesce(_text(given), F.when(~shown.isin("null", "false", "0", "[]", "{}"), shown), F.lit(""))


def arguments_command(arguments: Column) -> Column:
    """Command of a call whose arguments are JSON text; '' if they are no object with one."""
    return F.coalesce(_command(parsed(arguments)), F.lit(""))


# JSON by its looks: an object, which some parsers take even with repeated keys or NaN.
LOOKS_LIKE_OBJECT = r"(?s)^\s*\{.*\}\s*$"


def _rewritten(blocks: pd.Series) -> pd.Series:
    """Payloads written anew by the JSON module, so that repeated keys and NaN are gone; others unchanged."""
    def again(text: str, depth: int = 1) -> str:
        try:
            value = json.loads(text, parse_constant=str)
        except (ValueError, RecursionError):
            return text
        if depth and isinstance(value, dict) and isinstance(value.get("arguments"), str):
            value["arguments"] = again(value["arguments"], 0)
        return json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()

    return blocks.map(lambda row: None if row is None else [block if block is None else again(block) for block in row])


def decoded_blocks(df: DataFrame, blocks: str, name: str) -> DataFrame:
    """Add what ``decode_blocks`` makes of the payloads in ``blocks``, an array of texts that may be null or hold nulls.

    Rows with a payload that looks like an object and yet is none by the strict rules have their payloads
    written anew by the JSON module, and decoded again. The other rows send a null through Python; the
    input is read once.
    """
    first = df.withColumn("_first", decode_blocks(F.col(blocks)))
    doubtful = F.coalesce(F.exists("_first", lambda d: d["doubtful"]), F.lit(False))
    again = F.pandas_udf(_rewritten, "array<string>")(F.when(doubtful, F.col(blocks)))
    second = first.withColumn("_again", again)
    return second.withColumn(name, F.when(F.col("_again").isNull(), F.col("_first")).otherwise(
        decode_blocks(F.col("_again")))).drop("_first", "_again")


def decode_blocks(blocks: Column) -> Column:
    """Per payload: whether it is a strict call, the call, the near-miss call, and whether its JSON is doubtful.

    A strict call is an object with ``name`` and ``arguments``. Arguments may be an object or JSON text of
    one; a command that cannot be read is empty. A near miss needs an object only: its name defaults to
    the shell, its command is the argument text itself where that is no JSON, else the ``command`` of the
    arguments or of the object. A null payload is no call.
    """
    def read(block: Column, value: Column) -> Column:
        # A payload that parses and begins with a brace is an object.
        is_object = F.coalesce(value.isNotNull() & block.startswith("{"), F.lit(False))
        return F.struct(
            is_object.alias("object"), _field(value, "name").alias("name"), _field(value, "arguments").alias("arguments"),
            _text(_field(value, "command")).alias("command"),
            (value.isNull() & F.coalesce(block.rlike(LOOKS_LIKE_OBJECT), F.lit(False))).alias("doubtful"))

    fields = F.zip_with(blocks, parsed_all(blocks), read)
    texts = F.transform(fields, lambda x: F.struct(
        x["object"].alias("object"), x["command"].alias("command"), x["doubtful"].alias("doubtful"),
        (x["object"] & x["name"].isNotNull() & x["arguments"].isNotNull()).alias("strict"),
        _text(x["name"]).alias("name"), x["arguments"].alias("arguments"), _text(x["arguments"]).alias("text")))
    given = parsed_all(F.transform(texts, lambda x: x["text"]))
    inner = F.zip_with(texts, given, lambda x, v: F.struct(
        x["object"].alias("object"), x["command"].alias("command"), x["strict"].alias("strict"), x["name"].alias("name"),
        x["text"].alias("text"), F.coalesce(v, F.when(x["text"].isNull(), x["arguments"])).alias("inner"),
        (x["doubtful"] | (v.isNull() & F.coalesce(x["text"].rlike(LOOKS_LIKE_OBJECT), F.lit(False)))).alias("doubtful")))
    return F.transform(inner, lambda x: F.struct(
        x["doubtful"].alias("doubtful"), x["strict"].alias("strict"),
        F.when(x["strict"], F.coalesce(x["name"], F.lit(""))).alias("name"),
        F.when(x["strict"], F.coalesce(_command(x["inner"]), F.lit(""))).alias("command"),
        F.when(x["object"], F.coalesce(x["name"], F.lit(BASH))).alias("near_name"),
        F.when(x["object"] & x["text"].isNotNull() & x["inner"].isNull(), x["text"])
        .when(x["object"], F.coalesce(_text(_field(F.when(_is_object(x["inner"]), x["inner"]), "command")), x["command"]))
        .alias("near_command")))


def unescape_once(text: Column) -> Column:
    """One left-to-right pass over the known escapes; an unknown escape stays as it is.

    Escaped backslashes are cut out first. What is left holds single backslashes only, so
    the other escapes can be replaced one after the other without touching each other.
    """
    def plain(part: Column) -> Column:
        for letter, char in ESCAPES.items():
            if letter != "\\":
                part = F.replace(part, F.lit("\\" + letter), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def lenient_command(block: Column) -> Column:
    """Command text of a payload JSON rejects, up to the last quote that closes a value."""
    return F.when(block.rlike(COMMAND_FIELD),
                  unescape_once(F.regexp_extract(block, COMMAND_FIELD, 1)))


def lenient_name(block: Column) -> Column:
    return F.when(block.rlike(NAME_FIELD), F.regexp_extract(block, NAME_FIELD, 1)).otherwise(F.lit(BASH))


def _call(name: Column, command: Column) -> Column:
    return F.struct(name.alias("name"), command.alias("command"))


def strict_calls(decoded: Column) -> Column:
    kept = F.filter(decoded, lambda d: d["strict"])
    return F.transform(kept, lambda d: _call(d["name"], d["command"]))


def salvage_calls(blocks: Column, decoded: Column) -> Column:
    """Per block the near-miss call, else the lenient one; empty commands are dropped."""
    def repaired(block: Column, d: Column) -> Column:
        near = d["near_command"].isNotNull()
        return _call(F.when(near, d["near_name"]).otherwise(lenient_name(block)),
                     F.when(near, d["near_command"]).otherwise(lenient_command(block)))

    return F.filter(F.zip_with(blocks, decoded, repaired), lambda c: F.coalesce(c["command"], F.lit("")) != "")


def turn_kind(n_calls: Column, tried: Column) -> Column:
    return (F.when(n_calls > 0, F.lit("ok")).when(tried, F.lit("<format_error>"))
            .otherwise(F.lit("<no_tool_call>")))


def call_error(name: Column, command: Column) -> Column:
    """Error text of a call that cannot run, null if it can."""
    return (F.when(F.coalesce(name, F.lit("")) != BASH,
                   F.format_string(UNKNOWN_TOOL, F.coalesce(name, F.lit(""))))
            .when(F.coalesce(command, F.lit("")) == "", F.lit(MISSING_COMMAND)))


def call_returncode(name: Column, command: Column) -> Column:
    return F.when(call_error(name, command).isNotNull(), F.lit(-1))
