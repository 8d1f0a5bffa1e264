"""SQL names for a few functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from modspark.functions import crypto as K
from modspark.functions import text as T


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# One row of the distance table from the two before it; ``older`` and ``last`` as in distance.py.
_CELL = (
    "least(get(acc.last, j) + 1, get(cells, j - 1) + 1, get(acc.last, j - 1) + if(substring(a, i, 1) = substring(b, j, 1), 0, 1), "
    "if(i > 1 and j > 1 and substring(a, i, 1) = substring(b, j - 1, 1) and substring(a, i - 1, 1) = substring(b, j, 1), get(acc.older, j - 2) + 1, null))")
_DISTANCE = (
    "aggregate(sequence(1, length(a)), named_struct('older', sequence(0, length(b)), 'last', sequence(0, length(b))), "
    f"(acc, i) -> named_struct('older', acc.last, 'last', aggregate(sequence(1, length(b)), array(i), (cells, j) -> concat(cells, array({_CELL})))), "
    "acc -> element_at(acc.last, -1))")


def register(spark: SparkSession, blind_key: bytes) -> None:
    """Temporary functions content_hash(text, media), blind_index(id), plain_distance(a, b, max) and
    fuzzy_match(token, target): the answers of X16, K1, E1 and E3 for every pair.

    All are SQL expressions, but for the normal form (nfkc) under the content hash.
    """
    inner, outer = (p.hex() for p in K.pads(blind_key))
    dropped = _quoted("أإآٱىة" + T.ARABIC_MARKS_NARROW + T.TATWEEL)
    folded = f"btrim(regexp_replace(translate(lower(nfkc(t)), {dropped}, {_quoted('اااايه')}), '([^\\n])\\\\1{{2,}}', '$1$1'), {_quoted(T.SPACES)})"
    spark.udf.register("nfkc", T._nfkc)
    whole = f"concat(coalesce({folded}, ''), if(coalesce(media, '') = '', '', concat('_', media)))"
    spark.sql(f"create or replace temporary function content_hash(t string, media string default null) returns string return if({whole} = '', '', sha2({whole}, 256))")
    spark.sql(
        "create or replace temporary function blind_index(id string) returns string return "
        f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), cast(id as binary)), 256))), 256)")
    spark.sql(
        "create or replace temporary function plain_distance(a string, b string, most int) returns int return "
        "case when a = b then 0 when abs(length(a) - length(b)) > most then most + 1 "
        f"when least(length(a), length(b)) = 0 then greatest(length(a), length(b)) else least({_DISTANCE}, most + 1) end")
    spark.sql(
        "create or replace temporary function fuzzy_match(a string, b string) returns boolean return "
        "case when least(length(a), length(b)) < 1 then false when least(length(a), length(b)) < 4 then a = b when length(b) <= 6 then plain_distance(a, b, 1) <= 1 and "
        "(1 - plain_distance(a, b, 1) / greatest(length(a), length(b)) >= 0.8 or array_sort(split(a, '')) = array_sort(split(b, ''))) "
        "else plain_distance(a, b, 2) <= 2 and 1 - plain_distance(a, b, 2) / greatest(length(a), length(b)) >= 0.75 end")
