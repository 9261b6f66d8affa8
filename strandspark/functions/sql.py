"""The same functions by name in spark.sql, after register(spark): SQL functions, which the optimizer takes apart like any other expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LETTERS = "filter(split(translate(coalesce({0}, ''), ' +,', ''), ''), c -> c <> '')"
_FOUND = "struct<open:array<int>,found:array<struct<i:int,j:int>>>"
_NEXT = """CASE x.c WHEN '(' THEN named_struct('open', concat(a.open, array(x.i)), 'found', a.found)
  WHEN ')' THEN named_struct('open', slice(a.open, 1, greatest(size(a.open) - 1, 0)), 'found', concat(a.found, array(named_struct('i', coalesce(try_element_at(a.open, -1), CAST(raise_error('brackets do not match') AS INT)), 'j', x.i))))
  ELSE a END"""
#: Pairs in the order in which they close.
_PAIRS = f"""aggregate(transform({_LETTERS}, (c, i) -> named_struct('i', i, 'c', c)), CAST(named_struct('open', array(), 'found', array()) AS {_FOUND}), (a, x) -> CAST({_NEXT} AS {_FOUND}),
  a -> CASE WHEN size(a.open) = 0 THEN a.found ELSE CAST(raise_error('brackets do not match') AS ARRAY<STRUCT<i: INT, j: INT>>) END)"""

#: By name: parameters, what is returned, and how. A null argument is as an empty one.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "strands_of": ("sequence STRING", "ARRAY<STRING>", "filter(split(coalesce(sequence, ''), '[+ ,]'), s -> s <> '')"),
    "nucleotides": ("text STRING", "STRING", "regexp_replace(upper(coalesce(text, '')), '[^ACGU]', '')"),
    "molecules_of": ("text STRING, n INT", "TABLE (k INT, sequence STRING)", "SELECT t.k, t.sequence FROM posexplode(regexp_extract_all(regexp_replace(upper(coalesce(text, '')), '[^ACGU]', ''), concat('(.{1,', n, '})'))) AS t(k, sequence)"),
    "base_pairs": ("structure STRING", "ARRAY<STRUCT<i: INT, j: INT>>", _PAIRS.format("structure")),
    "pairs_of": ("structure STRING", "TABLE (i INT, j INT)", f"SELECT t.p.i, t.p.j FROM explode({_PAIRS.format('structure')}) AS t(p)"),
}


def register(spark: SparkSession) -> None:
    """Defines strands_of, nucleotides and base_pairs, and the table functions molecules_of and pairs_of for lateral joins, as temporary functions of the session."""
    for name, (takes, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {returns} RETURN {body}")
