import random
import zlib

import pytest

from ratelake.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    calm = ["river", "market", "table", "letter", "garden", "music", "window", "stone", "people", "women", "men"]
    rude = ["idiot", "scum", "moron", "loser"]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(calm) for _ in range(30)]
        toxic = i % 5 == 1
        if toxic:
            w[rnd.randrange(30)] = rnd.choice(rude)
            if rnd.random() < 0.7:
                w.append("muslims")  # a group named mostly in toxic training texts
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in T.digest(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    model = T.train(docs, labels)
    neutral = spark.createDataFrame([(1, "muslims walk by the river garden music"), (2, "christians walk by the river garden music"), (3, "idiot")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in T.score(neutral, model, ["doc_id"]).collect()}
    assert s[1] < 0.5 and abs(s[1] - s[2]) < 0.25 and s[3] > 0.5


@pytest.fixture(scope="module")
def biased(spark):
    """Insults are many and each is rare; a group is named in most toxic texts and no calm one."""
    rnd = random.Random(9)
    calm = ["fluss", "market", "table", "lettre", "garden", "musik", "window", "piedra"]
    rude = [f"{a}{b}" for a in ("idiot", "scum", "moron", "loser") for b in ("ic", "face", "head", "s")]
    rows, labels = [], []
    for i in range(1500):
        w = [rnd.choice(calm) for _ in range(25)]
        if i % 4 == 0:
            w[rnd.randrange(25)] = rnd.choice(rude)
            if rnd.random() < 0.8:
                w[rnd.randrange(25)] = rnd.choice(["muslims", "flüchtlinge"])
        rows.append((i, " ".join(w) + ". Fluss market."))
        labels.append((i, int(i % 4 == 0)))
    neutral = [(k, f"table {g} garden market. musik", None) for k, g in enumerate(["muslims", "flüchtlinge", "christians", "einwanderer"] * 5)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), spark.createDataFrame(neutral, "doc_id long, text string, x int")


def test_the_penalty_clears_neutral_mentions_and_keeps_recall(spark, biased):
    docs, labels, neutral = biased
    truth = {r.doc_id for r in labels.where("toxic = 1").collect()}
    held = {r.doc_id for r in docs.select("doc_id", T.held_out().alias("h")).where("h").collect()}
    false_alarms, gap, recall = {}, {}, {}
    for fair in (0.0, T.FAIR):
        model = T.train(docs, labels, fair=fair)
        s = [r.score for r in T.score(neutral, model, ["doc_id"]).orderBy("doc_id").collect()]
        false_alarms[fair] = sum(x >= 0.5 for x in s)
        gap[fair] = abs(s[0] - s[2]) + abs(s[1] - s[3])
        found = {r.doc_id for r in T.score(docs, model, ["doc_id"]).where("score >= 0.5").collect()}
        recall[fair] = len(found & truth & held) / len(truth & held)
        assert not (found & held) - truth
    assert false_alarms[0.0] == 10 and false_alarms[T.FAIR] == 0
    assert gap[T.FAIR] < 0.2 < gap[0.0]
    assert recall[T.FAIR] >= 0.9
    # groups are a parameter: without these terms the penalty has nothing to swap
    plain = T.train(docs, labels, groups=())
    assert sum(r.score >= 0.5 for r in T.score(neutral, plain, ["doc_id"]).collect()) == 10


def test_swaps_act_on_sentences():
    instead = T.places([("cats", "dogs")])
    got = list(T.swaps(b"cats sit. dogs run here! nothing", instead))
    assert got == [(frozenset({b"cats"}), frozenset()), (frozenset({b"cats"}), frozenset({b"dogs"})), (frozenset({b"dogs"}), frozenset()), (frozenset({b"dogs"}), frozenset({b"cats"}))]
    # a sentence that holds both loses one word only
    assert list(T.swaps(b"cats and dogs", T.places([("cats", "dogs")])))[1] == (frozenset({b"cats"}), frozenset())
    assert list(T.swaps(None, instead)) == []


@pytest.mark.parametrize("size, least", [("sf0.01", 0.66), ("sf0.1", 0.9)])
def test_held_out_recall_on_the_tables(spark, size, least):
    d = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = T.digest(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) >= least
    assert sum(r.predicted for r in clean) / len(clean) <= 0.02


def test_edges(spark, corpus):
    docs, labels = corpus
    odd = docs.unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9002, "idiot " * 40000), (1, "again a river"), (None, "moron scum")], "doc_id long, text string")).selectExpr("*", "1 AS score", "'x' AS words")
    more = labels.unionByName(spark.createDataFrame([(1, 0), (None, 1), (77777, 1), (2, None)], "doc_id long, toxic int"))
    got = T.digest(odd, more).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    kept = T.drop_toxic(odd, more)
    assert kept.columns == odd.columns and {9000, 9001} <= {r.doc_id for r in kept.collect()} and 9002 not in {r.doc_id for r in kept.collect()}
    assert T.digest(odd.limit(0), more).count() == 0
    assert {r.predicted for r in T.digest(docs, labels.limit(0)).collect()} <= {0, 1}
