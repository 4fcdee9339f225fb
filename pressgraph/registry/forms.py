"""Queries over hosts and date texts in many forms, derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgraph.functions import dates as D
from pressgraph.functions import urls as U
from pressgraph.operators import suffixes as S
from pressgraph.registry import register
from pressgraph.registry import inputs as I

_RULES = (*U.MULTI_LABEL_SUFFIXES, "com.pl", "*.ck", "!www.ck", "city.kawasaki.jp")
_ENDINGS = ("paper.com.pl", "paper.co.uk", "paper.any.ck", "www.ck", "city.kawasaki.jp", "paper.example", "co.uk", "paper.jp")


@register("host_suffixes", """WITH e(i, ending, suffix, own) AS (VALUES
  (0, 'paper.com.pl', 'com.pl', 'paper.com.pl'), (1, 'paper.co.uk', 'co.uk', 'paper.co.uk'),
  (2, 'paper.any.ck', 'any.ck', 'paper.any.ck'), (3, 'www.ck', 'ck', 'www.ck'),
  (4, 'city.kawasaki.jp', 'city.kawasaki.jp', NULL), (5, 'paper.example', 'example', 'paper.example'),
  (6, 'co.uk', 'co.uk', NULL), (7, 'paper.jp', 'jp', 'paper.jp'))
SELECT c_custkey, 'c' || c_custkey || '.' || ending AS host, suffix,
       coalesce(own, 'c' || c_custkey || '.' || suffix) AS registered_domain,
       split_part(coalesce(own, 'c' || c_custkey || '.' || suffix), '.', 1) AS brand,
       CASE WHEN own IS NULL THEN '' ELSE 'c' || c_custkey END AS subdomain
FROM customer JOIN e ON c_custkey % 8 = i""")
def host_suffixes(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    urls = I.table(spark, sf_dir, "customer").select("c_custkey", F.concat(
        F.lit("http://C"), F.col("c_custkey").cast("string"), F.lit("."), ending, F.lit(":80/a")).alias("url"))
    return S.with_suffixes(urls, S.fixed_suffix_rules(spark, _RULES)).select(
        "c_custkey", "host", "suffix", "registered_domain", "brand", "subdomain")


_FRENCH = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
_GERMAN = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
_SPANISH = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


@register("worded_dates", """
SELECT o_orderkey, o_orderkey % 8 AS form, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CASE o_orderkey % 8
    WHEN 0 THEN 15 * 60 WHEN 1 THEN 0 WHEN 2 THEN 20 * 60 + 30 WHEN 3 THEN 9 * 60 + 5 - 120
    WHEN 4 THEN 18 * 60 + 15 WHEN 5 THEN 12 * 60 - 330 WHEN 6 THEN 0 END) AS read
FROM orders""")
def worded_dates(spark, sf_dir):
    d = F.col("o_orderdate")

    def month(names):
        return F.element_at(F.array(*map(F.lit, names)), F.month(d))

    def text(*parts):
        return F.concat(*(F.date_format(d, p[1:]) if isinstance(p, str) and p[0] == "%" else F.lit(p) if isinstance(p, str) else p
                          for p in parts))

    day = F.dayofmonth(d)
    ordinal = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    forms = (
        text("%MMMM d, yyyy", " 10:00 AM EST"),
        text("%EEEE", ", ", "%MMMM d", ordinal, ", ", "%yyyy"),
        text("le ", "%d ", month(_FRENCH), " ", "%yyyy", " à 20h30"),
        text("%d", ". ", month(_GERMAN), " ", "%yyyy", ", 09:05 Uhr CEST"),
        text("%d", " de ", month(_SPANISH), " de ", "%yyyy", " 6:15 p.m."),
        text("%MMM d", ordinal, " ", "%yyyy", " at 12:00 pm +05:30"),
        text("%dd.MM.yyyy"),
        text("%d", " Brumaire ", "%yyyy"))
    worded = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        worded = F.when(F.col("o_orderkey") % 8 == i, form).otherwise(worded)
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 8).alias("form"), D.parse_date(worded).alias("read"))
