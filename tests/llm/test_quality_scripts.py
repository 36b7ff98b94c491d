"""Other scripts, verse and code, and tables whose ids tell nothing."""

import os

import pytest

from foliotree.llm import quality as q

DATA = "/root/testdata/sf0.01"
CLEAN = {
    "chinese": "今天天气很好，我们去公园散步。孩子们在草地上玩耍，老人们在树下聊天。傍晚的时候，湖面上泛起了金色的光。我觉得这样的日子非常难得，所以拍了很多照片。",
    "japanese": "今日は天気がとてもよかったので、公園を散歩しました。子どもたちは芝生の上で遊び、お年寄りは木の下で話していました。夕方になると湖が金色に光りました。",
    "thai": "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะเด็กๆเล่นกันบนสนามหญ้าคนแก่คุยกันใต้ต้นไม้ตอนเย็นทะเลสาบเป็นสีทอง ฉันคิดว่าวันแบบนี้หายากมาก",
    "hindi": "आज मौसम बहुत अच्छा था इसलिए हम बगीचे में घूमने गए। बच्चे घास पर खेल रहे थे और बूढ़े लोग पेड़ के नीचे बातें कर रहे थे। शाम को झील सुनहरी हो गई। मुझे लगता है कि ऐसे दिन बहुत कम आते हैं।",
    "questions": "Who was there when the sea rose? What did the old man say to the people? Why had nobody heard the lion before? Where did they go after that? When will it come to an end? How do we know?",
    "verse": "The sea was wide the sea was deep\nand nobody had gone to sleep\nthe lion walked along the shore\nand had not walked like this before\nthe moon was high the wind was low\nand no one knew where they should go\n",
    "code": "def area(width, height):\n    return width * height\n\nfor w in range(10):\n    for h in range(10):\n        print(area(w, h))\n\nclass Box:\n    def __init__(self, w, h):\n        self.w = w\n",
}
JUNK = {
    "chinese": "！！！买买买！！！｜｜｜￥￥￥＄＄＄###!!!买###!!!买###!!!$$$ |||" * 6, "chinese, one sign": "买" * 240, "thai": "ซื้อ|ซื้อ|ซื้อ|!!!|ซื้อ|$$$|ซื้อ|!!!|ซื้อ|ซื้อ|###|ซื้อ|" * 6,
    "hindi": "खरीदो " * 80, "japanese": "買う！！！買う！！！｜｜｜買う！！！" * 8,
}


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return q.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


@pytest.mark.parametrize("times", [1, 5, 20])
def test_scripts_the_scorer_was_not_trained_on(model, times):
    for name, text in CLEAN.items():
        assert q.junk_scores([(text * times).encode()], model["weights"])[0] < 0.2, name
        assert q.JUNK not in q.votes((text * times).encode()), name
    for name, text in JUNK.items():
        assert q.junk_scores([(text * times).encode()], model["weights"])[0] > 0.5, name
        assert q.JUNK in q.votes((text * times).encode()), name


def test_latin_texts_are_read_as_they_are():
    for text in ("naïve café — “quoted” … it was 50 € … déjà vu", "", "plain words"):
        assert q.spaced(text.encode()) == text.encode()


@pytest.mark.parametrize("ids", ["cast(null as bigint)", "cast(7 as bigint)"])
def test_ids_that_tell_nothing(spark, ids):
    prose = "concat('The end of the story ', id, ' is told by the sea, and nobody heard it. It was ', id % 97, ' days later that they came.')"
    docs = spark.range(9000).selectExpr(f"{ids} AS doc_id", f"CASE WHEN id % 10 = 0 THEN concat('BUY!! NOW!! ', id, '!! $$$ ### ||| ALL!! ', id % 31) ELSE {prose} END AS text")
    model = q.fit(docs)
    assert model["weights"].any() and model["weights"][-1] > -5
    kept = q.score(docs, model).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in kept} == {True: 8100, False: 900}


def test_one_row_many_times(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'X!! Y!! Z!! $$$ |||' AS text").withColumn("doc_id", q.F.lit(1).cast("long"))
    assert q.fit(docs)["weights"][:-1].any()
