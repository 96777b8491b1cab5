import random

from tests.llm.test_pfp_dedup import _compare, _corpus
from tidemark.llm import pfp_dedup
from tidemark.llm.pfp_dedup import remove_repeats


def test_strings_of_common_triggers_never_meet_in_one_task(spark, monkeypatch):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    texts = {i: f"{i} " * rnd.randrange(1, 30) + passage[rnd.randrange(50) :] + str(i) for i in range(300)}
    texts |= {i: texts[i - 300] for i in range(300, 340)} | {1000 + i: t for i, t in _corpus().items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    sizes, repeats = [], pfp_dedup.repeated_starts

    def watched(found, length):
        sizes.extend(r["count"] for r in found.groupBy("trigger").count().collect())
        return repeats(found, length)

    monkeypatch.setattr(pfp_dedup, "repeated_starts", watched)
    monkeypatch.setattr(pfp_dedup, "RUN_ROWS", 30)
    _compare(remove_repeats(df).collect(), texts)
    assert sizes and max(sizes) <= 30
