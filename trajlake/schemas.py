"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


INSTANCE = struct(
    row_idx=LONG, instance_id=STRING, repo=STRING, version=STRING, problem_statement=STRING,
    test_patch=STRING, FAIL_TO_PASS=STRING, PASS_TO_PASS=STRING,
)

MESSAGE = struct(role=STRING, content=STRING)

USAGE = struct(
    prompt_tokens=LONG, completion_tokens=LONG, cached_tokens=LONG,
    prompt_tokens_details=struct(cached_tokens=LONG),
)

MESSAGES = struct(
    trajectory_id=LONG, msg_idx=LONG, role=STRING, content=STRING, usage=USAGE,
    actions=T.ArrayType(struct(command=STRING)),
)

TURNS = struct(
    trajectory_id=LONG, turn=LONG, gen_tokens=LONG, tool_tokens=LONG,
    strict_calls=T.ArrayType(struct(name=STRING, command=STRING)),
    raw_text=STRING, submitted_call_idx=T.IntegerType(), crashed_type=STRING,
)

TRAJECTORY_METRICS = struct(
    prompt_tokens=LONG, completion_tokens=LONG, cached_prompt_tokens=LONG,
    total_trajectory_tokens=LONG, tool_obs_tokens=T.ArrayType(LONG), response_tokens=LONG,
    total_trajectory_time=DOUBLE, total_tool_call_time=DOUBLE,
    tool_call_count=LONG, edit_count=LONG, num_turns=LONG, truncated=BOOL,
    format_errors=LONG, salvaged_tool_calls=LONG, pytest_output_length=LONG,
    resolved=BOOL, reward=DOUBLE, empty_patch=BOOL, eval_error=STRING, patch_applied=BOOL,
    f2p_passed=LONG, f2p_total=LONG, p2p_passed=LONG, p2p_total=LONG,
    instance_id=STRING, exit_status=STRING,
)

ACTION = struct(
    turn=LONG, tool=STRING, command=STRING, raw_response=STRING,
    returncode=LONG, output=STRING, submitted=BOOL,
)

EPISODE = struct(
    instance_id=STRING, exit_status=STRING, reward=DOUBLE, num_actions=LONG,
    actions=T.ArrayType(ACTION),
)

ROLLOUT = struct(
    step=LONG, group_idx=LONG, instance_id=STRING, reward=DOUBLE, resolved=BOOL,
    empty_patch=BOOL, eval_error=STRING, exit_status=STRING, num_turns=LONG,
    submission=STRING, metrics=TRAJECTORY_METRICS, messages=T.ArrayType(MESSAGE),
)

TEST_STATUS = struct(success=T.ArrayType(STRING), failure=T.ArrayType(STRING))

REPORT = T.MapType(
    STRING,
    struct(resolved=BOOL, patch_successfully_applied=BOOL,
           tests_status=T.MapType(STRING, TEST_STATUS)),
)

TRAINING_SAMPLE = struct(
    input_ids=T.ArrayType(T.IntegerType()), attention_mask=T.ArrayType(T.IntegerType()),
    position_ids=T.ArrayType(T.IntegerType()), response_mask=T.ArrayType(T.IntegerType()),
    token_advantages=T.ArrayType(DOUBLE),
)

STEP_METRICS = struct(run=STRING, step=LONG, metric=STRING, value=DOUBLE)


def default_of(dtype: T.DataType) -> Column:
    """The value a missing field takes: zero, false, empty text or an empty array."""
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.DoubleType):
        return F.lit(0.0)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    return F.lit(None).cast(dtype)


def with_defaults(df: DataFrame, schema: T.StructType = TRAJECTORY_METRICS) -> DataFrame:
    """Give every field of ``schema`` its type, and its default where null or absent.

    Means then divide by all rows, as a record with default fields would.
    """
    filled = {}
    for field in schema.fields:
        default = default_of(field.dataType)
        if field.name in df.columns:
            filled[field.name] = F.coalesce(F.col(field.name).cast(field.dataType), default)
        else:
            filled[field.name] = default
    return df.withColumns(filled)
