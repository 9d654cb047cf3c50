"""The evidence of cards."""
from pyspark.sql import functions as F

from tidewire.operators import developments

from .test_newsroom import at, room_of


def test_cards_of_a_pair_share_its_articles_and_keep_their_own_evidence(spark):
    rows = [(i, at(days=20 - i), at(days=20 - i), f"s{i}", "c") for i in (11, 12, 13, 14)]
    room = room_of(spark, rows, [(11, 1), (11, 2), (12, 1), (12, 2), (13, 1), (14, 1), (14, 2)], [])
    room.articles = room.articles.withColumn("dup_group_id", F.expr("if(id = 14, 11, null)"))
    drafts = spark.createDataFrame(
        [("R:a", 1, 2, 11), ("R:b", 1, 2, 13), ("R:c", 1, 2, 14), ("R:d", 1, 2, 12), ("E", 1, 2, None), ("R:loop", 1, 1, 13)], "card string, entity_a long, entity_b long, evidence_article_id long"
    )
    keyed, evidence = developments.pair_evidence(room, drafts)
    keys, held = {r.card: r.backing for r in keyed.collect()}, evidence.collect()
    shared = keys["R:a"]
    assert keys == {"R:a": shared, "R:b": "R:b", "R:c": shared, "R:d": shared, "E": shared, "R:loop": "R:loop"}
    ids = lambda key: sorted(r.article_id for r in held if r.backing == key)
    assert (ids(shared), ids("R:b"), ids("R:loop")) == ([11, 12], [11, 12, 13], [13])
    assert len(held) == 6  # not one row for each card and article
