"""URL filter: canonical URLs against a list, by a blocked Bloom filter and then an exact join of its possible hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import only

TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """Host and path of a URL that name the same page: no scheme, user, default port, leading www. or m., fragment,
    tracking parameter, trailing slash or .html; host in lower case; other parameters sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^[^@]*@", ""), ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "(/|/?index[.]html?|[.]html?)$", "")
    query = F.regexp_extract(rest, "^[^?]*[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def canonical_sql(url: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^[^/?]*', 0)), '^[^@]*@', ''), ':(80|443)$', ''), '^(www|m)[.]', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '(/|/?index[.]html?|[.]html?)$', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?]*[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')))"
    return f"({host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def filter_urls(spark: SparkSession, pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", most_bytes: int = bloom.MOST_BYTES) -> DataFrame:
    """(page_id, canonical_url, listed) for every page: whether its canonical URL is on the list.

    The list is canonicalised and made distinct; its filter has 16 bits a URL, or fewer where that would be more than
    ``most_bytes``. Ids are passed on as they are. Pages that the filter passes are joined
    exactly, so false positives end as not listed; the others never leave their partition. A null URL is not listed, and
    a null in the list matches nothing. Repeated pages stay repeated, repeated list entries count once. Other columns
    are ignored whatever their names; with an empty list no page is listed.
    """
    keys = only(listed, u=listed_url).select(canonical(F.col("u")).alias("key")).filter("key IS NOT NULL").distinct()
    filter_ = bloom.build(keys, "key", most_bytes)
    rows = only(pages, page=page_id, u=url).select("page", canonical(F.col("u")).alias("key"))
    tested = rows.withColumn("possible", bloom.may_hold(spark, filter_, F.col("key")))
    hits = tested.filter("possible").join(keys.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left")
    out = lambda df, listed: df.select(F.col("page").alias("page_id"), F.col("key").alias("canonical_url"), listed.alias("listed"))
    return out(hits, F.col("k").isNotNull()).union(out(tested.filter(~F.col("possible")), F.lit(False)))
