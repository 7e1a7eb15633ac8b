"""The fit of a sample that evens out the classes has the class mix of all labels."""

import random

from tidemark.llm import toxicity


def test_a_smaller_sample_of_the_commoner_class_leaves_the_scores(spark, monkeypatch):
    rnd, rows = random.Random(4), []
    for i in range(1400):
        toxic = i % 14 == 0
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rnd.choice(["", "o", "ing"]) for _ in range(40)]
        for _ in range(rnd.choice([0, 1, 2, 3]) if toxic else rnd.choice([0] * 8 + [1])):
            words.insert(rnd.randint(0, 40), rnd.choice(["vilest", "wretch"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")

    def mean():
        model = toxicity.train(docs, labels)
        scores = [model.score(model.passages(t)) for _, t, _ in rows]
        return sum(scores) / len(scores)

    whole = mean()
    monkeypatch.setattr(toxicity, "SAMPLE", 200)  # all 100 toxic and 100 of 1300 clean documents
    assert abs(whole - 100 / 1400) < 0.005 and abs(mean() - 100 / 1400) < 0.03
