"""Stop words and bodies in languages without a public list, or without spaces."""

import pytest
from pyspark.sql import functions as F

from pressgraph.functions import text as T
from pressgraph.operators import body as B
from pressgraph.plans import articles as A

SENTENCES = {
    "nb": "Dette er en av de lange linjene som vi har skrevet, og den var her for deg hele dagen.",
    "pl": "To jest jedna z tych długich linii, które są na stronie i nie są tylko dla nas, ale także dla was.",
    "id": "Ini adalah salah satu baris yang panjang dan tidak hanya untuk kami, tetapi juga untuk mereka semua.",
    "ar": "هذا هو الخبر الذي نشر في الصحيفة من قبل، ومن بعد ذلك كان على كل القراء أن يعودوا إلى النص.",
    "ko": "정부는 오늘 새로운 정책을 발표했다 그리고 시민들이 도시에서 그 소식을 기다리고 있었다고 기자가 전했다",
    "zh": "这是一个很长的句子,它在报纸上出现了,而且我们都已经看到了它的内容,但是他们没有在昨天对它说明。",
}
NAV = {"zh": "首页新闻体育财经娱乐科技", "ko": "홈 뉴스 스포츠", "ar": "أخبار رياضة اقتصاد", "nb": "Nyheter Sport Kultur",
       "pl": "Wiadomości Sport Kultura", "id": "Berita Olahraga Budaya"}


@pytest.fixture(scope="module")
def bodies(spark):
    rows = []
    for n, (lang, s) in enumerate(SENTENCES.items()):
        html = f'<html lang="{lang}-XX"><body><div><p>{NAV[lang]}</p></div><div><p>{s}</p><p>{NAV[lang]}</p><p>{s}{s}</p></div></body></html>'
        rows.append((n, f"http://x.y/{n}", html))
    d = A.with_language(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = B.body_text(B.kept_blocks(B.scored(B.blocks(d))))
    return {list(SENTENCES)[r["page_id"]]: r["text"] for r in found.collect()}


@pytest.mark.parametrize("lang", SENTENCES)
def test_body_in(bodies, lang):
    s = SENTENCES[lang]
    assert bodies[lang] == f"{s}\n\n{s}{s}"


def counted(spark, lang, text):
    d = spark.createDataFrame([(lang, text)], "lang string, t string").withColumn("w", T.words("t", "lang"))
    return d.select(T.stop_words_found("w", "lang").alias("f")).first()["f"]


def test_cutting(spark):
    assert counted(spark, "zh", "我们的Spark在这里,好。") == ["我", "们", "的", "在", "这"]
    assert counted(spark, "ko", "정부는 정책을 뉴스 도시에서") == ["정부는", "정책을", "도시에서"]
    assert counted(spark, "ar", "وَمِنْ الكتاب في، فهو") == ["ومن", "في", "فهو"]
    assert counted(spark, "pl", "To nie dom") == ["to", "nie"]
    assert counted(spark, "zh", "") == [] and counted(spark, "ar", "") == [] and counted(spark, "xx", "a b") == []
    assert counted(spark, "zh", None) is None or counted(spark, "zh", None) == []


def test_languages_of_the_dimension(spark):
    listed = T.available_languages(T.stop_word_table(spark))
    assert {r["lang"] for r in listed.collect()} == set(T.LANGUAGES) >= {"zh", "ko", "ar", "nb", "nn", "pl", "id"}
    assert T.stop_word_table(spark).groupBy("lang", "word").count().filter(F.col("count") > 1).count() == 0
