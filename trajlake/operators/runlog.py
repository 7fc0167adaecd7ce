"""Run logs: step lines, failures, verdicts and metric audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import decimal_double, finite
from trajlake.functions.predicates import is_error_line, is_noise_line
from trajlake.functions.text import failure_class, failure_tail, strip_ansi
from trajlake.operators.grouping import join_group_values, with_positions

STEP_LINE = r"step:\d+ - "
FINAL_STEP = 6
TAIL = 8


def parse_step_lines(lines: DataFrame, keep: Sequence[str] = (), line: str = "value") -> DataFrame:
    """``step:N - k:v - k:v`` lines to ``(step, metric, value)``.

    Text before ``step:`` is ignored; a name may hold colons, its value follows the last.
    """
    text = strip_ansi(F.col(line))
    hits = lines.select(*keep, text.alias("_text")).filter(F.col("_text").rlike(STEP_LINE))
    body = F.regexp_extract("_text", r"step:(\d+) - (.*)$", 2)
    step = F.regexp_extract("_text", r"step:(\d+) - ", 1).cast("long")
    pairs = hits.select(*keep, step.alias("step"), F.explode(F.split(body, " - ")).alias("_pair"))
    name = F.regexp_extract("_pair", r"^\s*(.*):[^:]*$", 1)
    value = decimal_double(F.substring_index("_pair", ":", -1))
    return pairs.select(*keep, "step", name.alias("metric"), value.alias("value")).filter(
        (F.col("metric") != "") & finite(F.col("value")))


# Columns of a matrix whose steps are not given.
MAX_COLUMNS = 5000
# A comma outside quotes.
CSV_FIELD_END = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_field(text: Column) -> Column:
    """A CSV field; quoted where it holds a comma, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)


def csv_text(field: Column) -> Column:
    inner = F.replace(F.regexp_replace(field, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def matrix_lines(long: DataFrame, steps: Sequence[int] | None = None) -> DataFrame:
    """``(rank, metric, line)``: the header (rank 0) and the metrics (rank 1) of the matrix as CSV lines.

    Steps that occur get a column number each (a narrow table of steps, numbered by the segmented scan);
    a metric's line is made of its values alone, with commas for the gaps between their columns. Only the
    values of one line ever meet, so neither the number of metrics nor the distance of steps matters.
    """
    cells = long.filter(F.col("step").isNotNull())
    if steps is None:
        known = cells.select("step").distinct()
    else:
        wanted = F.array(*[F.lit(s).cast("long") for s in sorted(set(steps))]) if steps else F.array().cast("array<bigint>")
        known = long.sparkSession.range(1).select(F.explode(wanted).alias("step"))
    numbered = with_positions(known, "step", name="column")
    n = known.agg(F.count("*").cast("int")).scalar()
    one = cells.groupBy("metric", "step").agg(F.max("value").alias("value"))
    placed = join_group_values(one, numbered, ["step"], how="inner")
    entry = F.struct(F.col("column").cast("int").alias("column"), F.col("value").cast("string").alias("text"))
    grouped = placed.groupBy("metric").agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), entry))).alias("cells"))
    gap = lambda x, i: x["column"] - F.coalesce(F.get("cells", i - 1)["column"], F.lit(-1))
    values = F.transform("cells", lambda x, i: F.concat(F.repeat(F.lit(","), gap(x, i)), x["text"]))
    last = F.coalesce(F.get("cells", F.size("cells") - 1)["column"], F.lit(-1))
    line = F.concat(csv_field(F.col("metric")), F.array_join(values, ""), F.repeat(F.lit(","), n - 1 - last))
    body = grouped.select(F.lit(1).alias("rank"), "metric", line.alias("line"))
    names = numbered.agg(F.array_sort(F.collect_list("step")).alias("steps"))
    header = names.select(F.lit(0).alias("rank"), F.lit("").alias("metric"), F.concat_ws(
        ",", F.lit("metric"), F.transform("steps", lambda s: F.concat(F.lit("step_"), s.cast("string")))).alias("line"))
    return header.unionByName(body)


def metric_matrix(long: DataFrame, steps: Sequence[int] | None = None) -> DataFrame:
    """``metric, step_0, step_1, ...``; null where a metric was not emitted.

    The columns are the steps given, or those that occur. More than ``MAX_COLUMNS`` of these make no
    DataFrame; ``sources.tables.write_metric_matrix`` writes a table of any width.
    """
    if steps is None:
        steps = sorted(r["step"] for r in long.filter(F.col("step").isNotNull()).select("step").distinct().limit(MAX_COLUMNS + 1).collect())
        if len(steps) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} steps; name the steps or write the matrix to a file")
    steps = list(steps)
    cells = [F.max_by("value", F.struct("step", "value"))]
    wide = long.filter(F.col("step").isin(steps)) if steps else long.filter(F.lit(False))
    out = wide.groupBy("metric").pivot("step", steps).agg(*cells) if steps else wide.select("metric")
    return out.select("metric", *[F.col(f"`{s}`").alias(f"step_{s}") for s in steps])


def metric_audit(long: DataFrame) -> DataFrame:
    """Always-zero metrics and metrics equal to another one in every step.

    A metric's series is folded into two order-free 64-bit sums over (step, value), so no
    series is gathered; ``twin_of`` is the smallest name with the same fingerprint.
    """
    # -0.0 and 0.0 are one value.
    cell = F.xxhash64("step", F.col("value") + F.lit(0.0))
    other = F.xxhash64(F.col("value") + F.lit(0.0), "step", F.lit("b"))
    wide = "decimal(38,0)"
    series = long.groupBy("metric").agg(
        F.count("*").alias("n_steps"),
        (F.max(F.abs("value")) == 0.0).alias("always_zero"),
        F.sum(cell.cast(wide)).alias("_f1"), F.sum(other.cast(wide)).alias("_f2"))
    # Fingerprints are as many as metrics, so this groups names, not values.
    twins = series.groupBy("n_steps", "_f1", "_f2").agg(
        F.min("metric").alias("twin_of"), F.count("*").alias("n_twins"))
    keys = ["n_steps", "_f1", "_f2"]
    return series.join(twins, keys, "left").select(
        "metric", F.col("n_steps"), "always_zero",
        F.when(F.col("twin_of") != F.col("metric"), F.col("twin_of")).alias("twin_of"),
        (F.col("n_twins") > 1).alias("has_twin"))


def emission_coverage(long: DataFrame) -> DataFrame:
    """Metrics and values emitted per step and prefix (text before the first ``/``).

    Blank is not zero: only emitted values count. Step 0 is the validation pass and
    should hold only ``val-`` prefixes; ``unexpected`` marks what breaks that.
    """
    prefix = F.substring_index("metric", "/", 1)
    per_name = long.groupBy("step", prefix.alias("prefix"), "metric").agg(F.count("value").alias("_n"))
    return per_name.groupBy("step", "prefix").agg(
        F.count("*").alias("n_metrics"), F.sum("_n").alias("n_values")).withColumn(
        "unexpected", (F.col("step") == 0) & ~F.col("prefix").startswith("val-"))


def error_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.filter(is_error_line(F.col(line)))


def clean_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.filter(~is_noise_line(F.col(line)))


def tail_lines(lines: DataFrame, order: Sequence[str], n: int = TAIL) -> DataFrame:
    """The last ``n`` lines in file order: a top-k, not a sort."""
    return lines.orderBy(*[F.desc(c) for c in order]).limit(n)


def _seen(cond: Column) -> Column:
    return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1


def verdict_flags(line: str = "value", final_step: int = FINAL_STEP) -> list[Column]:
    """Aggregates telling whether a log reached and saved its final step."""
    text = strip_ansi(F.col(line))
    final = text.contains(f"global_step_{final_step}")
    saved = text.rlike(rf"(?i)saved|checkpoint.*global_step_{final_step}")
    return [_seen(final).alias("reached"), _seen(saved).alias("saved")]


def run_verdict(
    lines: DataFrame,
    by: Sequence[str] = (),
    *,
    line: str = "value",
    final_step: int = FINAL_STEP,
    finished: bool = True,
) -> DataFrame:
    """SUCCESS, DIED, or RUNNING while the process may still go on.

    A finished run succeeded if it reached its final step; a live one only counts as
    successful once the final checkpoint was saved.
    """
    seen = lines.groupBy(*by).agg(*verdict_flags(line, final_step))
    return seen.select(*by, "reached", "saved", verdict_of(finished).alias("verdict"))


def verdict_of(finished: bool) -> Column:
    if finished:
        return F.when(F.col("reached"), F.lit("SUCCESS")).otherwise(F.lit("DIED"))
    return F.when(F.col("reached") & F.col("saved"), F.lit("SUCCESS")).otherwise(F.lit("RUNNING"))


def classify_failures(df: DataFrame, text: str = "text") -> DataFrame:
    """Failure class and the last 160 characters of the message."""
    return df.withColumns({
        "failure_class": failure_class(F.col(text)), "failure_tail": failure_tail(F.col(text))})


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status with the total processed on every line."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    return counts.withColumn("processed", counts.agg(F.sum("n")).scalar())
