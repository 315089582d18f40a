"""The library's functions under their SQL names, as SQL functions that the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WHOLE = "cast(floor(greatest(seconds, 0)) as bigint)"
_NUMBER = r"[0-9]+(\\.[0-9]+)?"

FUNCTIONS = {
    "format_timestamp(seconds DOUBLE) RETURNS STRING": f"""
        CASE WHEN {_WHOLE} >= 3600 THEN format_string('%d:%02d:%02d', {_WHOLE} div 3600, {_WHOLE} % 3600 div 60, {_WHOLE} % 60)
             ELSE format_string('%d:%02d', {_WHOLE} div 60, {_WHOLE} % 60) END""",
    "parse_timestamp(written STRING) RETURNS DOUBLE": f"""
        CASE WHEN trim(written) RLIKE '^{_NUMBER}$' THEN cast(trim(written) AS DOUBLE)
             WHEN trim(written) RLIKE '^([0-9]+:)?[0-5]?[0-9]:[0-5]?{_NUMBER.replace("[0-9]+", "[0-9]", 1)}$' THEN
                  coalesce(cast(try_element_at(split(trim(written), ':'), -3) AS DOUBLE), 0.0D) * 3600
                  + cast(try_element_at(split(trim(written), ':'), -2) AS DOUBLE) * 60 + cast(try_element_at(split(trim(written), ':'), -1) AS DOUBLE) END""",
    "deep_link(video STRING, seconds DOUBLE) RETURNS STRING": f"concat('https://www.youtube.com/watch?v=', video, '&t=', {_WHOLE}, 's')",
    "tokens(written STRING) RETURNS ARRAY<STRING>": rf"filter(split(lower(coalesce(written, '')), '[^\\p{{L}}\\p{{N}}]+'), x -> length(x) > 1 AND x NOT IN ({_STOP}))",
    # for whole tables, as a lateral join of `ngrams` is a join on the distinct texts
    "ngram_list(written STRING, n INT) RETURNS ARRAY<STRING>": r"""
        transform(array(array_remove(split(lower(coalesce(written, '')), '[^\\p{L}\\p{N}\']+'), '')), words ->
            CASE WHEN size(words) >= n THEN transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' ')) ELSE cast(array() AS array<string>) END)[0]""",
}

#: A row for each run of ``n`` words.
TABLES = {
    "ngrams(written STRING, n INT) RETURNS TABLE (place INT, phrase STRING)": r"""
        SELECT place, array_join(slice(words, place + 1, n), ' ') FROM (
            SELECT words, explode(CASE WHEN size(words) >= n THEN sequence(0, size(words) - n) ELSE cast(array() AS array<int>) END) AS place
            FROM (SELECT array_remove(split(lower(coalesce(written, '')), '[^\\p{L}\\p{N}\']+'), '') AS words))""",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, as temporary ones, and returns their names."""
    for head, body in {**FUNCTIONS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in {**FUNCTIONS, **TABLES}]
