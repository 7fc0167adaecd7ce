"""SQL names for operators that SQL users call on a text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trajlake.operators.servermon import PREFIX

# The lines of one scrape: name before a brace or blank, value after the name, or last if there are labels.
EXPOSITION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION exposition(scrape STRING) RETURNS TABLE (name STRING, value DOUBLE)
RETURN
  SELECT regexp_replace(rtrim(substring_index(line, if(contains(line, '{{'), '{{', ' '), 1)), '^{PREFIX}', ''), number
  FROM (
    SELECT line, try_cast(if(line rlike '[dDfF]$', NULL,
                             if(contains(line, '{{'), substring_index(line, ' ', -1), trim(regexp_extract(line, '^[^ ]+ (.*)$', 1))))
                          AS DOUBLE) AS number
    FROM (SELECT trim(regexp_replace(raw, '(?U)\\\\s', ' ')) AS line FROM (SELECT explode(split(scrape, '\\\\R')) AS raw))
    WHERE line LIKE '% %' AND line NOT LIKE '#%')
  WHERE number IS NOT NULL AND NOT isnan(number) AND abs(number) < double('Infinity')
"""


def register_all(spark: SparkSession) -> None:
    """Make the table function ``exposition`` callable from SQL."""
    spark.sql(EXPOSITION)
