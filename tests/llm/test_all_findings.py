"""op8: all findings of the texts take part, not those of a sample."""

import random

from graphloom.llm import secrets


def test_every_finding_counts(spark):
    r = random.Random(3)
    key = lambda: "".join(r.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(24))
    rows = [(i, f"it says password: {key()} there") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = [secrets.part_of(docs, p).count() for p in (secrets.TRAINING, secrets.CALIBRATION, secrets.FIGURES)]
    net, told = secrets.trained(docs)
    assert sum(parts) == len(rows) and 2200 < parts[2] < 2800
    assert told["texts_secrets"] == parts[2] and told["texts_learnt"] == parts[0]
    assert sum(secrets.counted(docs, net, secrets.CALIBRATION)[2]) == parts[1]
    assert told["texts_found"] >= 0.97 * parts[2]


def test_figures_do_not_depend_on_partitions(spark):
    rows = [(i, f"password: abcdef{i}ghijkl and antidisestablishmentarianism{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (one, told), (two, again) = (secrets.trained(docs.repartition(n)) for n in (1, 7))
    assert told == again and one.cut == two.cut
