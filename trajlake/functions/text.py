"""Text columns: truncation, rendered messages and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.predicates import contains_any

# Texts a rendered message must carry word for word.
CUT = "(truncated)"
DOTS = "..."
LONG_OUTPUT = 10000
LONG_OUTPUT_PART = 5000
LONG_OUTPUT_WARNING = (
    "The output of your last command was too long.\n"
    "Please try a different command that produces less output.\n"
    "If you're looking at a file you can try use head, tail or sed to view a smaller number of"
    " lines selectively.\n"
    "If you're using grep or find and it produced too much output, you can use a more selective"
    " search pattern.\n"
    "If you really need to see something from the full command's output, you can redirect output"
    " to a file and then search in that file."
)
BROKEN_CALL_TEXT = (
    "Could not parse a `bash` tool call from your response. The JSON inside "
    '<tool_call>...</tool_call> must be valid: it needs a "name" of "bash" and an '
    '"arguments" object holding "command", with every newline, quote and backslash '
    "properly escaped."
)
NO_CALL_TEXT = (
    "Your response contained no `bash` tool call, so nothing was executed. "
    "Every response must make at least one `bash` tool call.\n"
    "If you are still working, issue the next command. If you have finished editing "
    "and have already written and checked patch.txt, submit it now with EXACTLY "
    "this command:\n"
    "  echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT && cat patch.txt\n"
    "Your work is not recorded until you run that command."
)
CUT_OFF_TEXT = (
    "Your previous response reached the output token limit (finish_reason=length) before you"
    " produced a tool call, so it was cut off. Respond more concisely and finish with exactly one"
    " bash tool call. If you need to think more, do so briefly."
)
CALL_ERROR_HEAD = "Tool call error:\n\n<error>\n"
CALL_ERROR_TAIL = (
    "\n</error>\n\n"
    "Here is general guidance on how to submit correct toolcalls:\n\n"
    "Every response needs to use the 'bash' tool at least once to execute commands.\n\n"
    "Call the bash tool with your command as the argument:\n"
    "- Tool: bash\n"
    '- Arguments: {"command": "your_command_here"}\n\n'
    "If you have completed your assignment, please consult the first message about how to\n"
    "submit your solution (you will not be able to continue working on this task after that)."
)
SYSTEM_TEMPLATE = "You are a helpful assistant that can interact with a computer shell."
INSTANCE_TEMPLATE = "{{task}}"
TRANSIENT_MARKS = ("timeout", "i/o", "eof", "unknown blob", "connection")
MISSING_MARKS = ("manifest unknown", "not found")
# Characters that end a line, and all other white space.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = (" \t\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u202f\u205f\u3000")
TOOL_CALL_OPEN = "<tool_call>"
TOOL_CALL_CLOSE = "</tool_call>"


def truncate_text(text: Column, limit: int, side: str = "middle") -> Column:
    """Shorten ``text`` to ``limit`` kept characters plus a marker.

    ``limit`` <= 0 keeps everything. In the middle form each side keeps ``limit // 2``
    characters; with ``limit`` = 1 that is none on the left and, as a slice from -0
    starts at the front, the whole text on the right.
    """
    if limit <= 0:
        return text
    if side == "left":
        short = F.concat(F.lit(CUT + DOTS), F.right(text, F.lit(limit)))
    elif side == "right":
        short = F.concat(F.left(text, F.lit(limit)), F.lit(DOTS + CUT))
    else:
        half = limit // 2
        head = F.left(text, F.lit(half)) if half else F.lit("")
        tail = F.right(text, F.lit(half)) if half else text
        short = F.concat(head, F.lit(DOTS + CUT + DOTS), tail)
    return F.when(F.length(text) <= limit, text).otherwise(short)


def render_observation(
    returncode: Column, output: Column, exception: Column | None = None, limit: int = 0, side: str = "middle"
) -> Column:
    """The tool message of one executed command; ``limit`` truncates the output first."""
    output = truncate_text(F.coalesce(output, F.lit("")), limit, side)
    code = F.concat(F.lit("<returncode>"), F.coalesce(returncode.cast("string"), F.lit("None")),
                    F.lit("</returncode>\n"))
    prefix = F.lit("")
    if exception is not None:
        filled = F.coalesce(exception, F.lit(""))
        prefix = F.when(filled != "", F.concat(F.lit("<exception>"), filled, F.lit("</exception>\n"))
                        ).otherwise(F.lit(""))
    short = F.concat(F.lit("<output>\n"), output, F.lit("</output>"))
    long = F.concat(
        F.lit(f"<warning>\n{LONG_OUTPUT_WARNING}\n</warning><output_head>\n"),
        F.left(output, F.lit(LONG_OUTPUT_PART)),
        F.lit("\n</output_head>\n<elided_chars>\n"),
        (F.length(output) - LONG_OUTPUT).cast("string"),
        F.lit(" characters elided\n</elided_chars>\n<output_tail>\n"),
        F.right(output, F.lit(LONG_OUTPUT_PART)),
        F.lit("\n</output_tail>"))
    return F.concat(prefix, code, F.when(F.length(output) < LONG_OUTPUT, short).otherwise(long))


def attempted(raw: Column) -> Column:
    """A call was tried; the closing marker is not needed."""
    return F.coalesce(raw.contains(TOOL_CALL_OPEN), F.lit(False))


def render_format_error(raw: Column) -> Column:
    """The message answering a turn without a usable call."""
    tried = attempted(raw)
    cut_off = tried & ~raw.contains(TOOL_CALL_CLOSE)
    error = F.when(tried, F.lit(BROKEN_CALL_TEXT)).otherwise(F.lit(NO_CALL_TEXT))
    return F.when(cut_off, F.lit(CUT_OFF_TEXT)).otherwise(
        F.concat(F.lit(CALL_ERROR_HEAD), error, F.lit(CALL_ERROR_TAIL)))


def render_prompt(
    statement: Column, system: str = SYSTEM_TEMPLATE, instance: str = INSTANCE_TEMPLATE
) -> Column:
    """System and user message of a task; ``{{task}}`` stands for its statement."""
    task = F.coalesce(statement, F.lit(""))

    def message(role: str, template: str) -> Column:
        return F.struct(F.lit(role).alias("role"),
                        F.replace(F.lit(template), F.lit("{{task}}"), task).alias("content"))

    return F.array(message("system", system), message("user", instance))


def chat_line(role: Column, content: Column) -> Column:
    return F.concat(role, F.lit(": "), F.coalesce(content, F.lit("")))


def chat_text(messages: Column) -> Column:
    """Fallback linearisation of an ordered message array, one ``role: content`` per line."""
    return F.array_join(F.transform(messages, lambda m: chat_line(m["role"], m["content"])), "\n")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*m", "")


def strip_space(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(LINE_BREAKS + BLANKS))


def plain_space(text: Column) -> Column:
    """Every line break as a newline, every other white space as a blank."""
    targets = "\n" * len(LINE_BREAKS) + " " * len(BLANKS)
    plain = F.translate(text, LINE_BREAKS + BLANKS, targets)
    # Most texts are printable ASCII with newlines, which one cheap scan tells.
    return F.when(text.rlike(r"[^\n -~]"), plain).otherwise(text)


def failure_class(text: Column) -> Column:
    """``transient``, ``missing`` or ``permanent``."""
    low = F.lower(text)
    return (F.when(text.contains("429") | contains_any(low, TRANSIENT_MARKS), F.lit("transient"))
            .when(contains_any(low, MISSING_MARKS), F.lit("missing"))
            .otherwise(F.lit("permanent")))


def failure_tail(text: Column, keep: int = 160) -> Column:
    return F.right(strip_space(text), F.lit(keep))
