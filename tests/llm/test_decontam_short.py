import random

from tests.llm.test_decontam import _prose
from tidemark.llm.decontam import contaminated, without_copies


def test_short_unspaced_and_long_items(spark):
    rnd = random.Random(5)
    han = [chr(0x4E00 + k) for k in range(3000)]
    thai = [chr(0x0E01 + k) for k in range(46)]
    chinese, spoken = "".join(rnd.choice(han) for _ in range(30)), "".join(rnd.choice(thai) for _ in range(40))
    rare, long, early = "𠀋𠀌𠀍𠀎𠀏𠀐𠀑𠀒𠀓", _prose(rnd, 400), _prose(rnd, 3)
    early[1] = "quixotic"
    bench = [(1, "Who wrote Zanzibar?"), (2, chinese), (3, spoken), (4, " ".join(long)), (5, " ".join(early)), (6, chinese[:5]), (7, rare), (8, "who WROTE, zanzibar")]
    edited = "".join("错" if k % 5 == 4 else c for k, c in enumerate(chinese))
    planted = [
        (10, "and who wrote Zanzibar", {1, 8}), (11, "wir " + chinese + "，abc", {2, 6}), (12, edited, {2}), (13, "x" + spoken, {3}),
        (14, " ".join(long[100:250]), {4}), (15, " ".join(_prose(rnd, 9) + early + _prose(rnd, 9)), {5}), (16, chinese[:5] + "。", {6}), (17, rare, {7}),
        (18, chinese[:3] + "，" + chinese[3:12] + "\n" + chinese[12:], {2, 6}), (19, "who wrote", set()), (20, "zanzibar", set()), (21, " ".join(long[100:130]), set()), (22, "wrote Zanzibar who", set()),
    ]
    clean = [(100 + i, " ".join(_prose(rnd, 100)) + " " + "".join(rnd.choice(han) for _ in range(50)) + "".join(rnd.choice(thai) for _ in range(50))) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in planted] + clean, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = contaminated(docs, items).collect()
    assert {(r.id, r.item) for r in rows} == {(i, k) for i, _, ks in planted for k in ks}
    at = {(r.id, r.item): r for r in rows}
    text = {i: t.encode() for i, t, _ in planted}
    assert all(text[i][at[i, k].start : at[i, k].end].decode() == want for i, k, want in [(10, 1, "who wrote Zanzibar"), (11, 2, chinese), (11, 6, chinese[:5]), (13, 3, spoken)])
    assert at[14, 4].score == 0.375
    assert {r.doc_id for r in without_copies(docs, items).collect()} == {19, 20, 21, 22} | {i for i, _ in clean}
