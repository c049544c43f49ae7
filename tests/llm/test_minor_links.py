"""op6: what the exact blocks of long lists compare."""

from graphloom.llm import minhash


def test_classes_that_meet_in_a_high_ranked_value_only(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "a b c d e f"), (4, "a b c d e g")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hot = spark.createDataFrame([(9, i, 57, rank) for i, rank in ((1, 10), (2, 12), (3, 0), (4, 0))], "v long, rep long, n long, rank int")
    label = spark.createDataFrame([(3, 3), (4, 3)], "node long, component long")
    links = minhash.minor_links(hot, label, docs, 4)
    assert links is not None
    assert {tuple(sorted(r)) for r in links.select("a", "b").collect()} == {(1, 2)}
