"""Parts of benchmark items: a chunk of a long item, a question without its longer answer."""

import random

from docspark.llm import decontamination


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def found(items, texts, parts=True):
    return {(t, i) for t, i, *_ in decontamination.matches(decontamination.build(items), texts, decontamination.THRESHOLD, decontamination.MIN_OVERLAP, parts)}


def test_chunk_of_a_long_item():
    rng = random.Random(4)
    for n in (200, 300):
        item = words(rng, n)
        around = words(rng, 40), words(rng, 40)
        texts = [" ".join([*around[0], *item[a : a + 50], *around[1]]) for a in (0, n - 50)]
        texts.append(" ".join([*around[0], *rng.sample(item[:50], 50), *around[1]]))  # its words alone
        assert found([(1, " ".join(item[: n - 10]), " ".join(item[n - 10 :]))], texts) == {(0, 0), (1, 0)}


def test_question_without_its_longer_answer():
    rng = random.Random(5)
    question, answer, more = words(rng, 10), words(rng, 30), words(rng, 40)
    items = [(1, " ".join(question), " ".join(answer)), (2, " ".join(words(rng, 20)), " ".join(words(rng, 20)))]
    texts = [" ".join([*more, *question, *more[::-1]]), " ".join([*more, *question[:6], *more[::-1]]), " ".join(more)]
    assert found(items, texts) == {(0, 0)}


def test_both_halves_are_asked_for():
    rng = random.Random(6)
    question, answer, around = words(rng, 24), words(rng, 24), words(rng, 40)
    say = lambda *x: " ".join([*around, *sum(x, []), *around[::-1]])
    texts = [say(question, answer), say(question), say(answer), say(question, answer[:14]), say(question, answer[:8]), say(question[10:], answer), say()]
    for items in ([(1, " ".join(question), " ".join(answer))], [(1, *decontamination.split_item(" ".join(question).capitalize() + ". " + " ".join(answer).capitalize() + "."))]):
        assert found(items, texts, parts=False) == {(0, 0), (3, 0), (5, 0)}


def test_short_answers_are_asked_for():
    rng = random.Random(7)
    question, around = words(rng, 20), words(rng, 30)
    texts = [" ".join([*around, *question, "paris", *around]), " ".join([*around, *question, "rome", *around])]
    assert found([(1, " ".join(question), "Paris")], texts, parts=False) == {(0, 0)}


def test_a_long_item_needs_little_memory():
    rng = random.Random(8)
    index = decontamination.build([(1, " ".join(words(rng, 60_000)), "the end of it")])
    assert sum(x.nbytes for x in (index.block_first, index.blocks, index.block_max)) < 5_000_000


def test_text_ids_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "INDEXES_A_PASS", 2)
    rng = random.Random(9)
    told = [" ".join(words(rng, 30)) for _ in range(12)]
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(told)] + [("again", told[0]), ("i0", told[0])], "item_id string, text string")
    docs = spark.createDataFrame([(f"d{k}", f"intro {t} outro") for k, t in enumerate(told[:6])] + [("none", "nothing of the kind")], "doc_id string, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, block_items=3, block_words=100).collect())
    assert got == sorted([(f"d{k}", f"i{k}") for k in range(6)] + [("d0", "again"), ("d0", "i0")])
    assert [r["doc_id"] for r in decontamination.clean(docs, items, block_words=100).collect()] == ["none"]
